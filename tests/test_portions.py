"""Functions over texts pass results on in portions, and take whole texts."""

import numpy as np
import pyarrow as pa
import pytest

from dwellrank.functions import batches, models
from dwellrank.operators import attention, tokens
from dwellrank.plans import gaze

TEXTS = [["a", "b", "a"], ["c"], ["d", "d", "e", "f"], []]
STARTS = pa.array([[0, 2, 4], [0], [0, 2, 4, 6], []], pa.list_(pa.int32()))


def test_columns_and_rows():
    rows = [np.array([1.0, np.nan]), None, np.empty(0)]
    back = list(batches.list_rows(batches.list_column(rows).slice(0, 3)))
    assert np.array_equal(back[0], rows[0], equal_nan=True) and back[1] is None and len(back[2]) == 0
    spans = batches.struct_column([np.array([[1, 2], [3, 4]]), None], ("start", "end"), pa.int32())
    assert spans.to_pylist() == [[{"start": 1, "end": 2}, {"start": 3, "end": 4}], None]
    assert [m.tolist() for m in batches.matrix_rows(batches.matrix_column([np.eye(2), np.ones((1, 2))]))] == [np.eye(2).tolist(), [[1.0, 1.0]]]


def test_placement_in_portions(spark, monkeypatch):
    monkeypatch.setattr(tokens, "PORTION", 2)
    words = pa.array(TEXTS)
    out = list(tokens.align_words_udf(compat=False).func(iter([(STARTS, words, words)])))
    assert len(out) > 1
    assert [[s["start"] for s in row] for part in out for row in part.to_pylist()] == STARTS.to_pylist()


def test_encodings_in_portions(spark, monkeypatch):
    monkeypatch.setattr(models, "PORTION", 32)
    encoder = gaze.PieceEncoder()
    texts = ["one two", "three", "four five six"]
    found = {}
    monkeypatch.setattr(models.F, "arrow_udf", lambda kind: lambda f: found.setdefault(kind, f) and (lambda c: None))
    models.passage_encoding(gaze.PieceEncoder, None, 1 << 30)
    models.query_encoding(gaze.PieceEncoder, None)
    passage, query = found.values()
    parts = list(passage(iter([pa.array(texts)])))
    assert len(parts) == 3 and [r["tokens"] for p in parts for r in p.to_pylist()] == [encoder.encode_passage("passage: " + t, 1 << 30)["tokens"] for t in texts]
    parts = list(query(iter([pa.array(texts)])))
    assert len(parts) == 3 and all(abs(np.linalg.norm(v) - 1) < 1e-5 for p in parts for v in p.to_pylist())


def test_plugged_tokens_of_whole_texts(spark, tmp_path):
    rows = [(1, "abcd " * 700), (2, "x"), (3, " "), (4, None)]
    spark.createDataFrame([(k, t, "en", "web_1", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["n_chars"]) for r in gaze.plugged_tokens(spark, str(tmp_path)).collect()}
    assert got == {1: (700, 2800), 2: (1, 1)}


@pytest.mark.parametrize("words", [["ab", "cde"], ["AB", "cde"]])
def test_loads_by_bytes_are_those_by_strings(words):
    pieces, starts = ["a", "b", "cd", "e"], np.array([0, 1, 3, 5])
    one = [1.0, 1.0]
    column = lambda x: next(iter(attention._TextRows(pa.array([x]))))
    got = attention._loads(column(pieces), starts, column(words), [4.0, 6.0], one, one, False)
    want = attention.token_loads(pieces, starts, words, [4.0, 6.0], one, one, False)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and got[0].tolist() == [2, 2, 3, 3]
