"""Exact dedup, the shingle join, and vectors against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from dwellrank.llm import blocks, jaccard
from dwellrank.llm.neardup_vectors import fit_centroids, near_duplicates

from .conftest import ODD_TEXTS, sha, words


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    out = {}
    for body, group in groups.items():
        keep = min(group)[1]
        out |= {i: (keep, len(group), i == keep, sha(body)) for _, i in group}
    return out


@pytest.mark.parametrize("size", [1, 7, 4096])
def test_block_naming(documents, near_texts, size):
    rows = list(enumerate([*(t[:150] if t and size == 1 else t for t in [*ODD_TEXTS, *near_texts]), "ab" * 40, "ba" * 40, "a" * 80]))
    docs = documents([(i, t, None) for i, t in rows])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in blocks.exact_groups(docs, block_bytes=size).collect()}
    assert got == exact_by_hand(rows)
    if size == 4096:
        kept = blocks.kept_documents(docs)
        assert kept.columns == docs.columns
        assert {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_exact_dedup_of_nothing(documents):
    assert blocks.exact_groups(documents([])).collect() == []


def components_by_hand(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent,hubs,tile,dense", [(5, 80, 2, 256, 2), (5, 80, 1, 8, 0), (2, 60, 1, 16, 0), (2, 60, 1, 16, 1), (1, 90, 2, 256, 2)])
def test_jaccard_components(documents, near_texts, monkeypatch, width, percent, hubs, tile, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "HUB_ROUNDS", hubs)
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = list(enumerate([*ODD_TEXTS, *near_texts]))
    got = jaccard.jaccard_components(documents([(i, t, None) for i, t in rows]), width=width, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == components_by_hand(rows, width, percent)
    assert len(got) == len(rows)


def tile_rows(sets, tile=7):
    """A tile of these sets as its functions get it."""
    import pyarrow as pa

    sets = [np.sort(s) for s in sets]
    ids = np.arange(len(sets)) + 100
    columns = {
        "tile": np.full(len(sets), tile), "id": ids, "component": ids, "n": np.array([len(s) for s in sets]),
        "bitmap": pa.array([jaccard._bitmap(s) for s in sets], pa.binary()), "members": pa.array([s.tobytes() for s in sets], pa.binary()),
    }
    return pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for k, v in columns.items()})


def test_tiles_give_rows_in_proportion_to_their_sets():
    """A hundred sets that all link: no pairs leave the tile, and fewer links than sets; pairs of a sparse tile leave as they are."""
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 200).astype(np.uint64)
    alike = [np.unique(np.r_[base[np.arange(200) != k], draw.integers(0, 2**63, 1).astype(np.uint64)]) for k in range(100)]
    (pairs, sets) = jaccard._open([tile_rows(alike)], 80)
    assert (pairs.num_rows, sets.num_rows) == (0, 100)
    (links,) = jaccard._linked([tile_rows(alike)], 80)
    assert links.num_rows == 99
    other = [draw.integers(0, 2**63, 200).astype(np.uint64) for _ in range(50)]
    (pairs, sets) = jaccard._open([tile_rows([*other, *alike[:2]])], 80)
    assert (pairs.num_rows, sets.num_rows) == (1, 0) and pairs.column(1)[0].as_py() == 150
    far = [*other[:3], alike[0]]
    assert [b.num_rows for b in jaccard._open([tile_rows(far)], 80)] == [0, 0] and [b.num_rows for b in jaccard._linked([tile_rows(far)], 80)] == [0]


def test_jaccard_of_nothing(documents):
    assert jaccard.jaccard_components(documents([])).collect() == []


def test_bit_counts_never_exclude_a_link():
    draw = np.random.default_rng(2)
    for _ in range(300):
        n = int(draw.integers(1, 400))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[draw.permutation(a)[: int(len(a) * draw.uniform(0.7, 1))], draw.integers(0, 2**63, int(draw.integers(0, 40))).astype(np.uint64)])
        both = len(np.intersect1d(a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            small, large = sorted((a, b), key=len)
            assert jaccard._may_reach(len(small), jaccard._bitmap(small), len(large), jaccard._bitmap(large), 80)


def vectors_by_hand(rows, threshold):
    units = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            units[i] = (np.array(v) / np.linalg.norm(v), label)
    links = {i: {j for j in units if j != i and units[i][1] == units[j][1] and len(units[i][0]) == len(units[j][0]) and units[i][0] @ units[j][0] >= threshold} for i in units}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), i == min(seen))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_vectors(spark, monkeypatch, block):
    from dwellrank.llm import neardup_vectors

    monkeypatch.setattr(neardup_vectors, "BLOCK", block)
    draw = random.Random(3)
    rows = []
    for g in range(40):
        base = [draw.gauss(0, 1) for _ in range(12)]
        for _ in range(draw.choice((1, 2, 5, 12))):
            rows.append(([x + draw.gauss(0, 0.12) for x in base], g % 3))
    rows += [(rows[0][0], rows[0][1])] * 3 + [([2 * x for x in rows[0][0]], rows[0][1]), (rows[0][0], None), (None, 1), ([], 1), ([0.0] * 12, 1), ([float("nan")] * 12, 1), ([None] * 12, 1), ([1.0, 2.0], 1), ([1.0, 2.1], 1)]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as cell", "2 as id", "3 as copies")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicates(df, 0.93, cells=6).collect()}
    expected = vectors_by_hand(rows, 0.93)
    assert got.keys() == expected.keys()
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in expected.values())
    assert there > 100 and found >= 0.97 * there and all(got[i][0] <= expected[i][0] for i in got)
    assert got == expected if found == there else True
    assert near_duplicates(df.where("false")).collect() == []


def test_centroids_are_directions_of_their_vectors():
    draw = np.random.default_rng(0)
    centers = np.eye(5, 16)
    units = np.repeat(centers, 40, 0) + draw.normal(0, 0.05, (200, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    found = fit_centroids(units, 5, seed=4)
    assert np.allclose(np.linalg.norm(found, axis=1), 1)
    near = (units @ found.T).argmax(1)
    for c in np.unique(near):
        s = units[near == c].sum(0)
        assert np.allclose(found[c], s / np.linalg.norm(s))
