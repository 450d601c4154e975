import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellrank.operators import attention as A, embed as B, tokens as T


def dense(h, g, mask=None):
    s = (g[:, None] * h) @ h.T / np.sqrt(h.shape[1])
    if mask is not None:
        s[:, ~mask] = -np.inf
    p = np.exp(s - s.max(axis=1, keepdims=True))
    out = p / p.sum(axis=1, keepdims=True) @ h
    if mask is not None:
        out[~mask] = 0
    return out


@pytest.mark.parametrize(("cells", "keys"), [(1, 1 << 12), (64, 2), (1 << 18, 1), (1 << 18, 1 << 12)])
def test_attention_matches_dense(monkeypatch, cells, keys):
    monkeypatch.setattr(A, "BLOCK_CELLS", cells)
    monkeypatch.setattr(A, "KEY_BLOCK", keys)
    rng = np.random.default_rng(0)
    rows, inverse = rng.normal(size=(7, 5)), rng.integers(0, 7, 60)
    g = rng.random(60)
    got = np.vstack(list(A.attend(rows, inverse, g)))
    assert np.allclose(got, dense(rows[inverse], g), atol=1e-12)
    mask = rng.random(60) > 0.4
    assert np.allclose(np.vstack(list(A.attend(rows, inverse, g, mask))), dense(rows[inverse], g, mask), atol=1e-12)
    assert not np.vstack(list(A.attend(rows, inverse, g, np.zeros(60, bool)))).any()


def test_words_in_place():
    """The short way gives what the placement gives, with doubled and alike words too."""
    rng = np.random.default_rng(8)
    names = ["a", "a.", "A", "b", "bc", "c", "—", "e-", "“a”"]
    for n in range(300):
        words = [names[k] for k in rng.integers(0, len(names), rng.integers(1, 12))]
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        for compat in (True, False):
            spans = T.place_words(list(starts), words, words, compat)
            if A._in_place(words, list(words), compat):
                assert spans == [(s, s + len(w)) for s, w in zip(starts, words)]
            mass, looked = A.token_loads(words, starts, words, np.arange(1.0, len(words) + 1), [1] * len(words), [1] * len(words), compat)
            expected = np.zeros(len(words))
            for k, (a, b) in enumerate(spans):
                hit = [j for j, s in enumerate(starts) if s + len(words[j]) > a and s < b]
                expected[hit] += (k + 1) / len(hit)
            assert np.allclose(mass, expected)
    assert A._text_words(["un", "like", " mo", "ped"], [0, 2, 6, 9]) == (["unlike", "moped"], [0, 7])
    assert A._text_words(["un", "like", "mo", "ped"], [0, 2, 7, 9]) == (["unlike", "moped"], [0, 7])


def test_attention_of_a_part():
    rng = np.random.default_rng(2)
    rows, inverse, g = rng.normal(size=(5, 4)) * 30, rng.integers(0, 5, 40), rng.random(40)
    assert np.allclose(np.vstack(list(A.attend(rows, inverse, g, begin=7, past=23))), dense(rows[inverse], g)[7:23], atol=1e-12)


def test_states_merge_in_any_order():
    """Scores of hundreds on either side overflow no exponential; the parts of the keys may be merged in any order."""
    rng = np.random.default_rng(5)
    q, v, n = rng.normal(size=(6, 3)) * 40, rng.normal(size=(9, 3)) * 10, rng.integers(1, 4, 9).astype(float)
    whole = A.attention_state(q, v, n)
    parts = [A.attention_state(q, v[a:b], n[a:b]) for a, b in ((0, 2), (2, 3), (3, 9))]
    for order in ((0, 1, 2), (2, 0, 1), (1, 2, 0)):
        a, b, c = (parts[k] for k in order)
        got = A.merge_states(a, A.merge_states(b, c))
        assert np.allclose(got[0], whole[0]) and np.allclose(got[1], whole[1]) and np.allclose(got[2] / got[1][:, None], whole[2] / whole[1][:, None])


def test_attention_by_hand():
    h = np.eye(2)
    got = np.vstack(list(A.attend(h, np.array([0, 1]), np.array([1.0, 0.0]))))
    e = np.exp(1 / np.sqrt(2))
    assert np.allclose(got, [[e / (e + 1), 1 / (e + 1)], [0.5, 0.5]])


def test_pooling():
    got = A.pool_chunks(iter([np.array([[3.0, 0]]), np.array([[0.0, 4], [1, 1]])]), np.array([0, 2]), np.array([2, 3]), 2)
    assert np.allclose(got, [[0.6, 0.8], [2 ** -0.5] * 2])
    with pytest.raises(ValueError):
        A.pool_chunks(iter([np.ones((1, 2))]), np.array([1]), np.array([1]), 2)


def place(text, words, **options):
    import re

    found = list(re.finditer(r"\S+", text))
    return T.place_words([m.start() for m in found], [m.group() for m in found], words, **options)


def test_word_placement():
    assert place("“There will not be enough water.”", ["There", "will", "not", "be", "enough", "water."]) == [(1, 6), (7, 11), (12, 15), (16, 18), (19, 25), (26, 32)]
    assert place("Unlike mopeds, e-bicycles", ["Unlike", "mopeds,", "e-", "bicycles"]) == [(0, 6), (7, 14), (15, 17), (17, 25)]
    assert place("the the cat", ["the", "the", "cat"]) == [(0, 3), (0, 3), (8, 11)]
    assert place("the the cat", ["the", "the", "cat"], compat=False) == [(0, 3), (4, 7), (8, 11)]
    assert place("a — b", ["a", "-", "b"])[1] == (2, 3)
    for bad in (["x"], [" "]):
        with pytest.raises(ValueError):
            place("a b", bad)


def test_placement_column(spark):
    df = spark.createDataFrame([([0, 2], ["a", "b"], ["b"]), ([0, 2], ["a", "b"], ["zz"])], "s array<int>, t array<string>, w array<string>")
    loose = [r[0] for r in df.select(T.align_words_udf(strict=False)("s", "t", "w")).collect()]
    assert [(x["start"], x["end"]) for x in loose[0]] == [(2, 3)] and loose[1] is None
    with pytest.raises(Exception, match="cannot align"):
        df.select(T.align_words_udf()("s", "t", "w")).collect()


def test_token_loads():
    """Times are split over a word's tokens, a missing one is 0, a token nothing fell on has neither mass nor inspection."""
    mass, inspect = A.token_loads(["ab", "cd", "e", "f", "g"], [0, 2, 5, 7, 9], ["abcd", "e", "f"], [10.0, 5.0, float("nan")], [1, 1, 1], [1, 0, 1])
    assert mass.tolist() == [5, 5, 5, 0, 0] and inspect.tolist() == [1, 1, 0, 1, 0]
    assert np.allclose(A.distribution(np.zeros(4)), 0.25)


def test_odd_skips_count_as_read(spark):
    rows = spark.createDataFrame([("e", "r", i, "w", 1.0, s, i) for i, s in enumerate([0.0, 1.0, None, float("nan"), 0.4])], WORDS)
    got = T.reader_runs(rows).first()
    assert list(got["inspected"]) == [1, 0, 1, 1, 1]


def test_repeated_readings():
    mass, inspect = A.token_loads(["ab", "cd"], [0, 3], ["ab", "cd"], [0.0, 10.0], [1, 2], [1, 1])
    g = A.distribution(mass)
    w = np.array([0, np.log1p(10)]) + 1e-8
    assert np.allclose(g, w / w.sum()) and inspect.tolist() == [1, 0.5]
    with pytest.raises(ValueError, match="repeated reading"):
        A.token_loads(["e-bike"], [0], ["e-", "bike"], [1.0, 1.0], [2, 2], [0, 0])


def test_mean_gaze(spark):
    df = spark.createDataFrame([("e", [0.6, 0.4, 0.0]), ("e", [0.0, 0.2, 0.8]), ("f", [0.8, 0.2]), ("f", [0.2, 0.8])], "example_id string, weights array<double>")
    got = {r["example_id"]: r["weights"] for r in T.mean_gaze(df).collect()}
    assert np.allclose(got["e"], [0.3, 0.3, 0.4]) and np.allclose(got["f"], [0.5, 0.5])
    with pytest.raises(Exception, match="differ in length"):
        T.mean_gaze(df.withColumn("example_id", F.lit("e"))).collect()


def test_derangements(spark):
    rows = [(f"e{k}", k, f"r{i}") for k, n in enumerate((1, 2, 3, 60)) for i in range(n)]
    df = spark.createDataFrame(rows, "example_id string, example_ordinal int, reader_id string")
    for mapped in (T.deranged_rotation(df, 7), T.deranged_shuffle(df, 7)):
        got = mapped.collect()
        assert len(got) == len(rows)
        for k, n in enumerate((1, 2, 3, 60)):
            mine = [(r["reader_id"], r["source_reader"]) for r in got if r["example_id"] == f"e{k}"]
            assert sorted(s for _, s in mine) == sorted(r for r, _ in mine)
            assert n == 1 or all(a != b for a, b in mine)
    seeded = {(r["example_id"], r["reader_id"]): r["source_reader"] for r in T.deranged_shuffle(df, 7).collect()}
    names = sorted(f"r{i}" for i in range(3))
    rng, drawn = np.random.default_rng(7 + 2), list(names)
    rng.shuffle(drawn)
    while any(a == b for a, b in zip(names, drawn)):
        rng.shuffle(drawn)
    assert [seeded[("e2", r)] for r in names] == drawn


WORDS = "example_id string, reader_id string, word_index int, word string, trt double, skip double, src_ordinal bigint"


def embedded(spark, conditions, readers=("r1", "r2"), **options):
    text = "Alpha beta. Gamma alpha."
    q = spark.createDataFrame([("q1", "p1", text, "What is alpha?", 0)], "example_id string, paragraph_id string, paragraph_text string, question string, example_ordinal bigint")
    words = [(r, i, w) for r in readers for i, w in enumerate(text.split())]
    rows = spark.createDataFrame([("q1", r, i, w, float(10 * i + len(r)), float(i % 2), n) for n, (r, i, w) in enumerate(words)], WORDS)
    return B.embed(B.encode_texts(q), rows, conditions, 16, **options), text


def test_embeddings(spark):
    conditions = ["text", "actual_gaze", "mean_gaze", "shuffled_gaze", "actual_skip_hard", "predicted_trt_gaze"]
    df, text = embedded(spark, conditions)
    rows = df.collect()
    count = lambda c: sum(r["condition"] == c for r in rows)
    assert [count(c) for c in conditions] == [2, 4, 2, 4, 4, 2]
    assert {r["reader_id"] for r in rows if r["condition"] in ("text", "mean_gaze", "predicted_trt_gaze")} == {None}
    assert all(abs(np.linalg.norm(r["vec"]) - 1) < 1e-6 for r in rows)
    tokens = text.split()
    h = A.hash_rows([t.lower() for t in tokens], 16)
    got = {(r["condition"], r["reader_id"], r["chunk_id"]): np.array(r["vec"]) for r in rows}
    pooled = lambda m, a, b: m[a:b].mean(axis=0) / np.linalg.norm(m[a:b].mean(axis=0))
    gaze = {}
    for reader in ("r1", "r2"):
        w = np.log1p(np.array([10 * i + 2.0 for i in range(4)])) + 1e-8
        gaze[reader] = w / w.sum()
        m = dense(h, gaze[reader])
        assert np.allclose(got[("actual_gaze", reader, "p1:chunk=1")], pooled(m, 2, 4), atol=1e-6)
        s = dense(h, np.array([1.0, 0, 1, 0]))
        assert np.allclose(got[("actual_skip_hard", reader, "p1:chunk=0")], pooled(s, 0, 2), atol=1e-6)
    assert np.allclose(got[("text", None, "p1:chunk=0")], pooled(h, 0, 2), atol=1e-6)
    assert np.allclose(got[("mean_gaze", None, "p1:chunk=0")], pooled(dense(h, gaze["r1"]), 0, 2), atol=1e-6)
    t = np.array([0.5, 0.4, 0.5, 0.5])
    w = np.log1p(t) + 1e-8
    assert np.allclose(got[("predicted_trt_gaze", None, "p1:chunk=1")], pooled(dense(h, w / w.sum()), 2, 4), atol=1e-6)
    assert rows[0]["embedding_id"].startswith("q1::text::none::p1:chunk=") and {tuple(r["token_indices"]) for r in rows} == {(0, 1), (2, 3)}


def test_slices_of_long_texts(spark, monkeypatch):
    """Texts cut into slices of two tokens have the vectors of whole ones, every chunk once."""
    conditions = ["text", "actual_gaze", "mean_gaze", "actual_skip_hard"]
    order = lambda df: sorted((r["embedding_id"], r["text"], tuple(r["token_indices"]), [round(x, 5) for x in r["vec"]]) for r in df.collect())
    whole = order(embedded(spark, conditions)[0])
    monkeypatch.setattr(B, "SLICE_BITS", 1)
    monkeypatch.setattr(A, "OUT_CELLS", 1)
    assert order(embedded(spark, conditions)[0]) == whole


def test_a_weight_changes_a_vector(spark):
    df, _ = embedded(spark, ["actual_gaze"])
    q = spark.createDataFrame([("q1", "p1", "Alpha beta. Gamma alpha.", "?", 0)], "example_id string, paragraph_id string, paragraph_text string, question string, example_ordinal bigint")
    rows = spark.createDataFrame([("q1", "r1", i, w, 900.0 if i == 0 else 1.0, 0.0, i) for i, w in enumerate("Alpha beta. Gamma alpha.".split())], WORDS)
    other = {r["chunk_id"]: r["vec"] for r in B.embed(B.encode_texts(q), rows, ["actual_gaze"], 16).collect()}
    first = {r["chunk_id"]: r["vec"] for r in df.collect() if r["reader_id"] == "r1"}
    assert max(abs(a - b) for c in first for a, b in zip(first[c], other[c])) > 1e-4


def test_embedding_errors(spark):
    with pytest.raises(ValueError):
        embedded(spark, ["other"])
    q = spark.createDataFrame([("q1", "p1", "  ", " ")], "example_id string, paragraph_id string, paragraph_text string, question string")
    with pytest.raises(Exception, match="empty paragraph"):
        B.encode_texts(q).collect()
    with pytest.raises(Exception, match="empty query"):
        B.query_vectors(q, 8).collect()


def test_partition_count_does_not_matter(spark):
    df, _ = embedded(spark, ["actual_gaze", "mean_gaze"])
    order = lambda d: sorted((r["embedding_id"], tuple(r["vec"])) for r in d.collect())
    before = order(df)
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert [k for k, _ in order(embedded(spark, ["actual_gaze", "mean_gaze"])[0])] == [k for k, _ in before]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
