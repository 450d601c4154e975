"""Spans, reading times, mean weights and flat attention made in Arrow batches, against plain Python and expressions."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dwellrank.functions import reading, scores, text as X, tiles
from dwellrank.operators import attention as A, tokens as T

TEXTS = ["", None, "  one two\x1fthree ", "一二　三", "\u0085a b c d e​f", "abcdefghi (x) 'yes,' e-bike", "\U0001f600 \U0001f600\U0001f600 end"]


def test_words_pieces_and_windows(monkeypatch):
    monkeypatch.setattr(tiles, "PORTION_BYTES", 8)
    column = pa.array(["left out", *TEXTS * 3]).slice(1)
    rows = lambda f: [r for part in tiles.portions(column) for r in f(part).to_pylist()]
    plain = lambda spans: spans and [(s["start"], s["end"], s["text"]) for s in spans]
    for size, pattern in ((None, r"\S+"), (4, r"\S{1,4}")):
        found = rows(lambda t: tiles.word_column(t, size))
        assert [plain(r) for r in found] == [None if t is None else [(*m.span(), m[0]) for m in re.finditer(pattern, t)] for t in TEXTS * 3]
    found = rows(lambda t: tiles.window_column(t, 2, 1))
    assert [[s["text"].split() for s in r] for r in found] == [
        [w[k:k + 2] for k in range(max(1, len(w) - 1))] if w else [] for w in ((t or "").split() for t in TEXTS * 3)]
    assert all(s["text"] == t[s["start"]:s["end"]] for t, r in zip(TEXTS * 3, found) for s in r)


def test_reading_times_are_those_of_the_expressions(spark):
    chunks = [t for t in TEXTS if t is not None]
    df = spark.createDataFrame([(chunks,), ([],)], "c array<string>")
    plain = F.transform("c", lambda t: scores.log1p_mean(F.transform(X.words(t), reading.heuristic_trt)))
    for r in df.select(reading.heuristic_scores(F.col("c")).alias("s"), plain.alias("p"), F.transform("c", X.word_count).alias("n")).collect():
        assert r["s"]["score"] == pytest.approx(r["p"], abs=1e-15) and r["s"]["words"] == r["n"]


def test_mean_over_many_readers(spark, monkeypatch):
    """Rows of three texts in any order, runs of three tokens; no pass over the vectors but one."""
    monkeypatch.setattr(T, "RUN", 3)
    draw = np.random.default_rng(5)
    vectors = {e: draw.random((readers, n)) for e, readers, n in (("a", 7, 10), ("b", 1, 3), ("c", 40, 1))}
    rows = [(e, v.tolist()) for e, m in vectors.items() for v in m]
    df = spark.createDataFrame([rows[i] for i in draw.permutation(len(rows))], "example_id string, weights array<double>")
    got = {r["example_id"]: r["weights"] for r in T.mean_gaze(df.repartition(5)).collect()}
    assert set(got) == set(vectors)
    assert all(np.allclose(got[e], m.mean(0) / m.mean(0).sum()) for e, m in vectors.items())
    assert T.mean_gaze(df)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    with pytest.raises(Exception, match="differ in length"):
        T.mean_gaze(spark.createDataFrame([("a", [1.0] * n) for n in (4, 5)], df.schema)).collect()


@pytest.mark.parametrize(("distinct", "dim"), [(40, 16), (400, 16)])
def test_flat_attention(distinct, dim, monkeypatch):
    """Small weights: sums over the keys for each distinct token give the softmax; weights that are not small go the long way."""
    draw = np.random.default_rng(3)
    rows, inverse = A.unit_rows(draw.random((distinct, dim)) - 0.5), draw.integers(0, distinct, 3000)
    weights = A.distribution(draw.random(3000) * 400)
    monkeypatch.setattr(A, "attention_states", None)
    flat = np.vstack(list(A.attend(rows, inverse, weights)))
    part = np.vstack(list(A.attend(rows, inverse, weights, begin=7, past=2500)))
    monkeypatch.undo()
    monkeypatch.setattr(A, "FLAT", 0.0)
    assert np.abs(flat - np.vstack(list(A.attend(rows, inverse, weights)))).max() < 1e-11 and np.array_equal(part, flat[7:2500])
    monkeypatch.undo()
    sharp = np.vstack(list(A.attend(rows, inverse, weights * 3000)))
    assert np.abs(sharp - flat).max() > 1e-3


def test_predicted_weights(spark):
    words = "Alpha, beta (gamma) -- delta".split()
    df = spark.createDataFrame([(words, [0, 7, 12, 20, 23])], "t array<string>, s array<int>")
    for compat in (False, True):
        got = np.array(df.select(A.predicted_weights(F.col("t"), F.col("s"), compat=compat).alias("g")).first()["g"])
        mass = np.log1p(np.array([5, 4, 5, 0, 5]) / 10) + 1e-8
        assert np.allclose(got, mass / mass.sum())
