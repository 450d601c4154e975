"""Workers give memory back when a task ends, not when their next one begins."""

import weakref

import pyarrow as pa

from dwellrank.llm import blocks, common


class Held(list):
    pass


def test_memory_is_given_back_after_the_last_result(monkeypatch):
    seen, alive = [], []

    def results():
        held = Held([1, 2, 3])
        alive.append(weakref.ref(held))
        yield from held

    monkeypatch.setattr(common, "trimmed", lambda: seen.append(alive[0]()))
    assert list(common.relieved(results())) == [1, 2, 3]
    assert seen == [None]  # once, and what the function held is free by then


def test_tasks_of_exact_dedup_give_memory_back(spark, documents, tmp_path):
    """Fails where a task ends without it: worker functions are wrapped."""
    plans = []

    class Source:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, shape):
            plans.append(run)
            raise StopIteration

    try:
        blocks.identities(Source())
    except StopIteration:
        pass
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a b"])], ["doc_id", "text"])
    assert plans[0]([batch]).gi_code is common.relieved.__code__


def test_tiles_compare_bounded_portions():
    """What a tile's comparison holds at a time, many sets of one size in one tile; and every pair is a candidate once."""
    import tracemalloc

    from dwellrank.llm import jaccard

    n = 2000
    whole = pa.array([bytes([255]) * 32] * n)
    rows = pa.table({"tile": [7] * n, "id": list(range(n)), "component": list(range(n)), "n": [60] * n, "bitmap": whole})
    tiles = jaccard._Tiles(rows)
    tracemalloc.start()
    pairs = sum(len(i) for i, _ in tiles.candidates(80))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == n * (n - 1) // 2
    assert peak < 30e6
