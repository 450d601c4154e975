"""Large groups that links have joined in part: their rows and pairs grow with the group, not with its square."""

import numpy as np
import pyarrow as pa

from dwellrank.llm import jaccard


def test_linked_sets_of_a_large_group_are_not_multiplied(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 32)
    rows = [(5, 600, k, 0 if k >= 20 else k + 1, 100 + k % 3) for k in range(600)]
    got = jaccard._tiled(spark.createDataFrame(rows, "key long, g long, id long, component long, n long"), 80).collect()
    assert len(got) <= 600 + 20 * 3 * 19  # every set at home once, twenty guests in all cuts
    met = set()
    at = {}
    for r in got:
        at.setdefault(r["tile"], []).append(r)
    for tile in at.values():
        met |= {frozenset((a["id"], b["id"])) for a in tile if a["component"] for b in tile if a["component"] != b["component"] and (a["home"] or b["home"])}
    assert met == {frozenset((a, b)) for a in range(20) for b in range(600) if a != b}


def test_pair_of_many_groups_leaves_one():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**63, 200).astype(np.uint64)
    sets = [np.sort(np.r_[base[:190], draw.integers(0, 2**63, 10).astype(np.uint64)]) for _ in range(2)]

    def tile(key):
        columns = {"tile": pa.array([key] * 2), "home": pa.array([True] * 2), "key": pa.array([key] * 2), "id": pa.array([1, 2]), "component": pa.array([1, 2]), "n": pa.array([200] * 2)}
        columns |= {"bitmap": pa.array([jaccard._bitmap(s) for s in sets], pa.binary()), "keys": pa.array([[-4, 3, 9], [-5, 3, 9]], pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict(columns)

    assert sum(b.num_rows for key in (3, 9) for b in jaccard._open([tile(key)], 80)) == 1


def test_two_visitors_are_no_pair():
    s = np.sort(np.random.default_rng(3).integers(0, 2**63, 50).astype(np.uint64))
    columns = {"tile": [1, 1], "home": [False, False], "id": [1, 2], "component": [1, 2], "n": [50, 50], "bitmap": [jaccard._bitmap(s)] * 2}
    assert sum(b.num_rows for b in jaccard._open([pa.RecordBatch.from_pydict(columns)], 80)) == 0
