"""Near-duplicate vectors: spherical k-means assigns vectors to cells, cosines are computed blockwise within cells."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import components, written

#: Vectors that the centroids are fitted on at most, and vectors of the sample for each centroid at least.
SAMPLE_VECTORS, VECTORS_PER_CENTROID = 1 << 16, 8
#: Nearest cells that each vector belongs to. Two vectors meet if they have one in common.
CELLS = 4
#: Rows of a block of a cell; larger cells are cut into as many as they need, and every two are compared.
BLOCK = 256


def fit_centroids(units: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: each centroid is the direction of the sum of its vectors; an empty one takes the worst-placed vector."""
    draw = np.random.default_rng(seed)
    centroids = units[np.sort(draw.choice(len(units), k, replace=False))]
    before = None
    for _ in range(rounds):
        best, near = np.zeros(len(units)), np.zeros(len(units), np.int64)
        for at in range(0, len(units), 4096):
            cosines = units[at : at + 4096] @ centroids.T
            near[at : at + 4096], best[at : at + 4096] = cosines.argmax(1), cosines.max(1)
        if before is not None and (near == before).all():
            break
        before = near
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, units)
        empty = np.flatnonzero(np.bincount(near, minlength=k) == 0)
        if len(empty):
            sums[empty] = units[np.argsort(best, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


def _units(batches):
    """vec_id, label, dim and the unit vector's bytes of every row that can link."""
    for batch in batches:
        ids, labels, dims, out = [], [], [], []
        for i, v, label in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if v is None or label is None or not v or any(x is None for x in v):
                continue
            v = np.array(v, np.float64)
            largest = np.abs(v).max()
            if not np.isfinite(largest) or largest == 0:
                continue
            v = v / largest
            v = v / np.sqrt(v @ v) + 0.0  # no negative zero
            ids.append(i), labels.append(label), dims.append(len(v)), out.append(v.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "dim", "unit"])


def _stacked(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, dim)


def _assigned(batches, centroids: dict[int, np.ndarray]):
    for batch in batches:
        dims = batch.column(2).to_numpy()
        raw = batch.column(3).to_pylist()
        cells: list = [None] * batch.num_rows
        for dim in np.unique(dims).tolist():
            rows = np.flatnonzero(dims == dim)
            c = centroids[dim]
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                cosines = _stacked([raw[i] for i in part], dim) @ c.T
                m = min(CELLS, len(c))
                near = np.sort(np.argpartition(-cosines, m - 1, axis=1)[:, :m], axis=1)
                for i, n in zip(part.tolist(), near.tolist()):
                    cells[i] = n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cells"])


def _meets_first_here(a: list, b: list, cell: int) -> np.ndarray:
    """For every pair whether ``cell`` is the first cell that both have, so that a pair counts once."""
    width = max(map(len, [*a, *b]))
    x, y = (np.array([[*r, *[-k] * (width - len(r))] for r in side]) for side, k in ((a, 1), (b, 2)))
    earlier = np.zeros((len(a), len(b)), bool)
    for k in range(width):
        for j in range(width):
            same = x[:, k, None] == y[None, :, j]
            earlier |= same & (x[:, k, None] < cell)
    return ~earlier


def _compared(batches, threshold):
    """Rows come sorted by block pair. For each pair of blocks: linked copies of each row, and links that span what is connected."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            tile = held.column("tile").combine_chunks().to_numpy()
            cut = int(np.searchsorted(tile, tile[-1])) if len(tile) else 0
        else:
            cut = len(held) if held is not None else 0
        if not cut:
            continue
        done, held = held.slice(0, cut), held.slice(cut)
        tile = done.column("tile").combine_chunks().to_numpy()
        head = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
        ids, dims, cell, part, low, high, copies = (done.column(c).combine_chunks().to_numpy() for c in ("vec_id", "dim", "cell", "part", "low", "high", "copies"))
        raw, cells = done.column("unit").to_pylist(), done.column("cells").to_pylist()
        counts: dict[int, int] = {}
        edges = []
        for s, e in zip(head.tolist(), [*head[1:].tolist(), len(tile)]):
            left = [i for i in range(s, e) if part[i] == low[s]]
            right = left if low[s] == high[s] else [i for i in range(s, e) if part[i] == high[s]]
            if not left or not right:
                continue
            a, b = (_stacked([raw[i] for i in side], int(dims[s])) for side in (left, right))
            link = (a @ b.T) >= threshold
            if left is right:
                np.fill_diagonal(link, False)
            if not link.any():
                continue
            link &= _meets_first_here([cells[i] for i in left], [cells[i] for i in right], int(cell[s]))
            for side, n in ((left, link @ copies[right]),) if left is right else ((left, link @ copies[right]), (right, copies[left] @ link)):
                for i, k in zip(side, n.tolist()):
                    if k:
                        counts[int(ids[i])] = counts.get(int(ids[i]), 0) + k
            x, y = ids[left], ids[right]
            while link.any():  # the row with most links is tied to all of them; pairs they leave connected are left out
                hub = int(link.sum(1).argmax())
                spokes = np.flatnonzero(link[hub])
                edges += [(int(x[hub]), int(y[k])) for k in spokes]
                link[hub] = False
                if left is right:
                    link[:, hub] = False
                    link[np.ix_(spokes, spokes)] = False
                else:
                    tied = np.flatnonzero(link[:, spokes].any(1))
                    edges += [(int(x[r]), int(y[spokes[int(link[r, spokes].argmax())]])) for r in tied]
                    link[np.ix_(tied, spokes)] = False
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*counts, *(a for a, _ in edges)], pa.int64()), pa.array([*counts.values(), *[None] * len(edges)], pa.int64()), pa.array([*[None] * n, *(b for _, b in edges)], pa.int64())],
            ["vec_id", "links", "other"],
        )


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cells: int | None = None
) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors linked directly), component_id (smallest reachable vec_id), kept.

    Two vectors link if their labels (not null) and lengths are equal and their cosine, in double precision, is at least ``threshold``.
    Vectors that are null, empty, zero, or hold null or non-finite values, and rows without a label, link with nothing and stay. An empty
    table gives an empty result. Links are looked for among vectors with one of their CELLS nearest cells in common; there are
    as many cells as the square root of the number of vectors (or ``cells``), their centroids fitted on a bounded sample. Every vector is
    assigned and compared. Equal vectors are one with a number of copies; within a block no pair leaves the task, only counts and a spanning set of links.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    valid = written(source.mapInArrow(_units, "vec_id long, label string, dim int, unit binary"), "vectors-valid")
    unique = valid.groupBy("label", "dim", "unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    unique = written(unique.select(F.col("first").alias("vec_id"), "label", "dim", "unit", "copies"), "vectors-unique")
    centroids = {}
    for r in unique.groupBy("dim").count().collect():  # a row per vector length
        dim, n = r["dim"], r["count"]
        drawn = unique.where(F.col("dim") == dim).select("unit").where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE_VECTORS))) == 0).limit(SAMPLE_VECTORS)
        units = _stacked([x["unit"] for x in drawn.orderBy("unit").collect()], dim)
        k = max(1, min(cells or int(n**0.5), -(-len(units) // VECTORS_PER_CENTROID)))
        centroids[dim] = fit_centroids(units, k)
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)  # SAMPLE_VECTORS / 8 vectors at most for each length
    placed = unique.mapInArrow(lambda it: _assigned(it, shared.value), "vec_id long, label string, dim int, unit binary, copies long, cells array<int>")
    placed = written(placed, "vectors-placed")
    each = placed.withColumn("cell", F.explode("cells"))
    sizes = each.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    each = each.join(sizes.hint("rebalance"), ["label", "dim", "cell"])
    each = each.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = each.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    each = each.withColumn("tile", F.xxhash64("label", "dim", "cell", "low", "high"))
    tiles = each.repartition("tile").sortWithinPartitions("tile").select("tile", "vec_id", "dim", "unit", "copies", "cells", "cell", "part", "low", "high")
    found = written(tiles.mapInArrow(lambda it: _compared(it, threshold), "vec_id long, links long, other long"), "vectors-links")
    whole = components(found.where("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b")), "vectors")
    links = found.where("other is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    firsts = unique.select("vec_id", "label", "dim", "unit", "copies").join(links, "vec_id", "left").join(whole.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    firsts = firsts.select("label", "dim", "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    own = valid.join(firsts, ["label", "dim", "unit"]).select("vec_id", "n_links", "component_id")
    return source.select("vec_id").join(own, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        (F.coalesce("component_id", "vec_id") == F.col("vec_id")).alias("kept"),
    )
