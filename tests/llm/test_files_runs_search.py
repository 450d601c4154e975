"""Token files, periodic runs and ranked search against the library, brute force and SQL."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from dwellrank.llm import impact_search, queries, runs, token_files

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- token files


@pytest.mark.parametrize("percentile", [1, 50, 90, 100])
def test_blocks_round_trip(percentile):
    draw = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        for top in (1, 2, 300, 50257, 2**32):
            ids = draw.integers(0, top, n).astype(np.uint32)
            ids[draw.random(n) < 0.05] = min(top - 1, 7)
            ids[draw.random(n) < 0.02] = top - 1
            data, starts = token_files.pack_blocks(ids, percentile)
            assert (token_files.unpack_blocks(data, starts[:-1])[:n] == ids).all()
            assert len(data) == starts[-1] and len(starts) == -(-n // token_files.BLOCK) + 1


def test_blocks_are_patched():
    """255 small values and a large one take the width of the small ones and one exception."""
    ids = np.r_[np.arange(255) % 8 + 1000, 2**31].astype(np.uint32)
    data, starts = token_files.pack_blocks(ids)
    head = data[:8].view(token_files.BLOCK_HEADER)[0]
    assert (head["low"], head["width"], head["exceptions"]) == (1000, 3, 1)
    assert len(data) == 8 + 256 * 3 // 8 + 5


def test_range_of_a_segment():
    ids = np.random.default_rng(1).integers(0, 50257, 3000).astype(np.uint32)
    raw = token_files.segment(4, 77, [5, None], [1000, 2000], ids) + b"\n"
    (s,) = token_files.segments(raw)
    assert (s.part, s.before, s.ids, s.doc_ids.to_pylist(), s.lengths.tolist()) == (4, 77, 3000, [5, None], [1000, 2000])
    for a, b in ((0, 0), (0, 1), (255, 257), (256, 512), (700, 2999), (2999, 3000), (0, 3000)):
        assert (s.between(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError, match="segment"):
        list(token_files.segments(raw[:-1]))


def by_library(rows, end):
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(PATH), [], 0
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_token_files(spark, documents, tmp_path, monkeypatch):
    """Texts of all kinds, one without an id, special strings, several files and segments; ids are those of the library, in order over all files."""
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 500)
    monkeypatch.setattr(token_files, "LEAST_FILE_BYTES", 2000)
    draw = random.Random(2)
    rows = [(3 * k - 7, t) for k, t in enumerate(ODD_TEXTS)] + [(1000 - k, " ".join(draw.choice(["it's", "naïve ", "x<|endoftext|>y", "12²", "日本"]) for _ in range(30))) for k in range(60)]
    docs = documents([(d, t, "s") for d, t in [*rows, (None, "no id")]])
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, PATH, 2)
    got = token_files.read_token_files(spark, path, with_ids=True).collect()
    expected = by_library([*sorted(rows), (None, "no id")], 2)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected
    assert spark.read.format("binaryFile").load(path).count() > 1


def test_token_files_of_one_id(spark, documents, tmp_path, monkeypatch):
    """Rows that share an id are spread over files; each has its own place, and places have no gaps."""
    monkeypatch.setattr(token_files, "LEAST_FILE_BYTES", 500)
    docs = documents([(7, f"text number {k % 50}", "s") for k in range(300)] + [(8, "last", "s")])
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, PATH, 2)
    got = sorted((tuple(r) for r in token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [7] * 300 + [8]
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got[:-1])]).tolist()


def test_no_documents(spark, documents, tmp_path):
    docs = documents([(1, "x", "s")]).where("false")
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, PATH, 2)
    assert token_files.read_token_files(spark, path).collect() == []
    assert runs.periodic_runs(docs).collect() == []
    items = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert impact_search.top_documents(docs, items).collect() == []
    assert impact_search.top_documents(documents([(1, "x", "s")]), items.where("false")).collect() == []


# --- runs


def runs_by_hand(w, least=24, periods=3):
    """Every maximal stretch for every period, the smallest period only."""
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if j > i and n >= max(least, periods * q) and not any(s <= i and s + m >= i + n and q % p == 0 for s, m, p in out):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_small_alphabets():
    draw = random.Random(4)
    for _ in range(1500):
        w = [draw.randrange(draw.choice((1, 2, 3))) for _ in range(draw.randrange(50))]
        if draw.random() < 0.5:
            w = w[: draw.randrange(9)] + w[: draw.randrange(1, 9)] * draw.randrange(9) + w
        least, periods = draw.choice((2, 5, 24)), draw.choice((2, 3))
        assert [tuple(r) for r in runs.runs(w, least, periods).tolist()] == runs_by_hand(w, least, periods)


def test_suffix_tree_extensions():
    draw = random.Random(6)
    for _ in range(100):
        s = [draw.randrange(1, 3) for _ in range(draw.randrange(2, 40))]
        e = runs.Extensions(s, 3)
        i, j = np.array([(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]).T
        for a, b, got in zip(i.tolist(), j.tolist(), e.common(i, j).tolist()):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert got == n


def collapsed_by_hand(doc_id, text, tails):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if tails and doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = runs_by_hand(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join("%d,%d,%d\n" % r for r in found)), digest(text), [list(r) for r in found], text)


@pytest.mark.parametrize("tails", [False, True])
def test_periodic_runs(spark, documents, tails):
    draw = random.Random(9)
    rows = list(enumerate(ODD_TEXTS))
    for k in range(250):
        words_ = [draw.choice(["a", "bb", "é", "日本", f"w{draw.randrange(40)}"]) for _ in range(draw.randrange(120))]
        if k % 3 == 0:  # lines that recur far apart hold no run, others do
            line = [f"l{k}{j}" for j in range(20)]
            words_ = line + words_ + line * draw.choice((1, 3, 4)) + words_[:5]
        rows.append((100 + k, draw.choice([" ", "  ", "\n"]).join(words_)))
    rows += [(None, "x y " * 30), (100, "x y z " * 30), (9000, " ".join(f"t{k}" for k in range(4000)) + " u v" * 20)]
    got = runs.periodic_runs(documents([(d, t, "s") for d, t in rows]), tails=tails, with_text=True).collect()
    order = lambda r: tuple((x is None, str(x)) for x in (r[0], r[7]))
    assert sorted((tuple(r) for r in got), key=order) == sorted((collapsed_by_hand(d, t, tails) for d, t in rows), key=order)
    assert sum(r["n_runs"] for r in got) > 50


# --- search


def ranked_by_sql(docs, items):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", items.toPandas())
    return sorted(con.sql(queries.ORACLES["op12_impact_search"]).fetchall())


@pytest.mark.parametrize("shard", [7, 64, 8192])
def test_search(spark, documents, monkeypatch, shard):
    """Small and large shards, ties, repeated and odd texts; items with common, rare, repeated and no terms."""
    monkeypatch.setattr(impact_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(impact_search, "WIDTH", 4)
    monkeypatch.setattr(impact_search, "FIRST_SHARE", 2)
    draw = random.Random(shard)
    rows = list(enumerate(ODD_TEXTS)) + [(100 + k, " ".join(f"t{min(draw.randrange(90), draw.randrange(90))}" for _ in range(draw.randrange(60)))) for k in range(500)]
    rows += [(2000 + k, "the same text t1") for k in range(40)] + [(3000, "Rare-word t1, T2")]
    docs = documents([(d, t, "s") for d, t in rows])
    asked = ["t1 t2 t3 t50", "T1", "rare word", "same; text", "éß日本\U0001f600 x", "nowhere else", "", None, " ".join(f"t{k}" for k in range(60)), "one two", "t1 t1 t1"]
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    got = sorted(tuple(r) for r in impact_search.top_documents(docs, items).collect())
    assert got == ranked_by_sql(docs, items)
    assert {r[0] for r in got} == {0, 1, 2, 3, 4, 8, 9, 10}


def test_search_in_passes(spark, documents, monkeypatch):
    docs = documents([(k, f"a{k % 7} b{k % 11} c", "s") for k in range(200)])
    items = spark.createDataFrame([(k, f"a{k % 7} c b{k}") for k in range(30)], "item_id long, text string")
    whole = sorted(tuple(r) for r in impact_search.top_documents(docs, items).collect())
    monkeypatch.setattr(impact_search, "PASS_BYTES", 300)
    assert sorted(tuple(r) for r in impact_search.top_documents(docs, items).collect()) == whole == ranked_by_sql(docs, items)


def test_search_opens_few_intervals(monkeypatch):
    """One document with all terms among many with one each: bounds keep nearly all documents from being scored."""
    rows = [(k, f"x{k % 3} " + "filler " * 5) for k in range(3000)] + [(5000, "x0 x1 x2 rare")]
    import pyarrow as pa

    from dwellrank.llm.common import word_hashes

    terms = sorted([b"x0", b"x1", b"x2", b"rare"])
    ends = np.cumsum([len(t) for t in terms])
    h = word_hashes(np.frombuffer(b"".join(terms), np.uint8), ends - [len(t) for t in terms], ends)
    places = np.argsort(h)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "text"])
    (row,) = [r for b in impact_search._shards([batch], h[places], places) for r in b.to_pylist()]
    shard = impact_search.Shard(row, np.array([50, 10, 10, 10]), row["n_docs"], row["n_terms"])
    opened = []
    whole = shard.maxima
    monkeypatch.setattr(shard, "maxima", lambda a, b: (opened.append(len(a)), whole(a, b))[1])
    best = []
    shard.search(np.arange(4), best, 1, 0)
    assert best[0][2] == 5000 and sum(opened) < 20


def test_null_and_repeated_ids_in_search(spark, documents):
    docs = documents([(None, "a b", "s"), (4, "a b", "s"), (4, "a b", "s"), (2, "a c", "s"), (9, None, "s"), (10, "--", "s")])
    items = spark.createDataFrame([(1, "a"), (1, "c"), (None, "b")], "item_id long, text string")
    got = impact_search.top_documents(docs, items.withColumn("score", F.lit("clash"))).collect()
    assert sorted([(r["rank"], r["doc_id"]) for r in got if r["item_id"] is None]) == [(1, 4), (2, 4), (3, None)]
    assert sorted([(r["rank"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["item_id"] == 1]) == [(1, False, 2), (1, False, 2), (2, False, 4), (3, False, 4), (4, True, 0)]


def test_terms():
    assert impact_search.query_terms("Don't stop—Été 12a; T") == sorted(t.encode() for t in ("don", "t", "stop—Été", "12a"))
