"""Mixing sources to target weights by Pfair scheduling.

Each source's documents come in blocks. Block k of a source of weight w is released at slot floor((k - 1) / w) and due by
slot ceil(k / w); in every slot the released block with the earliest deadline is taken. So after any number of slots each
source has had its weight's share of them to within less than one block.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block.
BLOCK_ROWS = 8
#: Weights are multiples of 1 / PERIOD; the schedule repeats after so many slots.
PERIOD = 4096


def rounded_weights(weights: dict[str, float], period: int = PERIOD) -> dict[str, Fraction]:
    """Weights as multiples of 1 / period that sum to one: largest remainders, and at least one part for each source."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots")
    if any(not w > 0 for w in weights.values()):
        raise ValueError("target weights must be positive")
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    spare = period - sum(parts.values())
    ranked = sorted(weights, key=lambda s: (parts[s] - exact[s], s))
    while spare:
        for s in ranked if spare > 0 else sorted((s for s in parts if parts[s] > 1), key=lambda s: (exact[s] - parts[s], s)):
            if not spare:
                break
            parts[s] += 1 if spare > 0 else -1
            spare -= 1 if spare > 0 else -1
    return {s: Fraction(n, period) for s, n in parts.items()}


def schedule(weights: dict[str, Fraction], slots: int) -> list[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of each slot: earliest deadline first, ties by name."""

    def window(s, k):
        return int((k - 1) / weights[s]), -int(-k // weights[s])

    waiting = [(window(s, 1)[0], s, 1) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, k)[1], s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out.append((s, k, release, deadline))
        heapq.heappush(waiting, (window(s, k + 1)[0], s, k + 1))
    return out


def mixed_order(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS, period: int = PERIOD
) -> DataFrame:
    """One row per document: doc_id, source, block (from 1), slot, release, deadline, position, in_mix.

    ``weights``: target share by source; sources without one (or all, for None) have the square root of their number of
    documents. Within a source documents are in the order of their ids' hashes. ``position`` orders the mixture;
    ``in_mix`` is true up to the first slot whose source has no block left, so the shares hold over the whole mixture; what lies
    behind it has its place in the schedule too. A null source is a source of its own. An empty table gives an empty result.

    The schedule is computed for one period, whatever the data; a block's slot follows from it by arithmetic. Documents are
    ranked in buckets of their hash, the square root of the largest source in number, so a source of any size is spread over many tasks.
    """
    spark = docs.sparkSession
    placed = _placed(docs, weights, id_col, source_col, block_rows, period)
    if placed is None:
        return spark.createDataFrame([], "doc_id long, source string, block long, slot long, release long, deadline long, position long, in_mix boolean")
    return placed.select(
        "doc_id",
        F.expr("case when source = '-' then null else substring(source, 2) end").alias("source"),
        (F.col("k") + 1).alias("block"),
        "slot",
        (F.col("release0") + F.col("turn")).alias("release"),
        (F.col("deadline0") + F.col("turn")).alias("deadline"),
        "position",
        "in_mix",
    )


def _placed(docs: DataFrame, weights: dict[str, float] | None, id_col: str, source_col: str, block_rows: int, period: int) -> DataFrame | None:
    """Each row of ``docs``, as the struct ``row``, with its place in the schedule; None for an empty table.

    Rows are not told apart by their ids; those of one source without an id are ranked in one task. The period's table is bounded, so it is broadcast.
    """
    spark = docs.sparkSession
    named = F.concat(F.when(F.col(source_col).isNull(), "-").otherwise("+"), F.coalesce(F.col(source_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), named.alias("source"), F.struct("*").alias("row"))
    count = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per source
    given = {f"+{s}": w for s, w in (weights or {}).items()}
    share = {s: given.get(s, n**0.5) for s, n in count.items()}
    if not share:
        return None
    fractions = rounded_weights(share, period)
    pattern = schedule(fractions, period)
    parts = {s: int(w * period) for s, w in fractions.items()}
    places: dict[str, list[tuple[int, int, int]]] = {s: [] for s in parts}
    for t, (s, _, release, deadline) in enumerate(pattern):
        places[s].append((t, release, deadline))
    missing = {s: -(-n // block_rows) for s, n in count.items()}  # the number of blocks is the index of the first that is not there
    horizon = min(k // parts[s] * period + places[s][k % parts[s]][0] for s, k in missing.items())

    buckets = 1 << (max(count.values()).bit_length() // 2)  # about as many as the documents of each
    rows = rows.withColumn("draw", F.xxhash64("doc_id"))
    rows = rows.withColumn("bucket", F.floor((F.col("draw").cast("double") / 2.0**64 + 0.5) * buckets).cast("int"))
    before = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("source", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("draw", "doc_id"))
    rows = rows.withColumn("rank", rank).join(before.hint("rebalance"), ["source", "bucket"])
    rows = rows.withColumn("index", F.col("before") + F.col("rank") - 1)

    table = spark.createDataFrame(
        [(s, k, parts[s], *place) for s, each in places.items() for k, place in enumerate(each)], "source string, at long, parts long, slot0 long, release0 long, deadline0 long"
    )
    sizes = F.create_map(*[F.lit(x) for s, n in parts.items() for x in (s, n)])
    rows = rows.withColumns({"k": F.expr(f"index div {block_rows}"), "parts": sizes[F.col("source")]})
    rows = rows.withColumns({"at": F.col("k") % F.col("parts"), "turn": F.expr(f"(k div parts) * {period}")}).drop("parts")
    rows = rows.join(F.broadcast(table), ["source", "at"]).withColumn("slot", F.col("slot0") + F.col("turn"))
    return rows.withColumns({"position": F.col("slot") * block_rows + F.col("index") % block_rows, "in_mix": F.col("slot") < horizon})


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", every: bool = False) -> DataFrame:
    """The documents in the order of the mixture over the files that are written next.

    With ``every``, all rows of ``docs``, also those whose id is null or on several rows: the weights shape the order only. A source without blocks
    drops out and the others go on in their proportions. Otherwise the rows in ``in_mix`` alone, over which the shares of all sources hold.
    """
    placed = _placed(docs, weights, id_col, source_col, BLOCK_ROWS, PERIOD)
    if placed is None:
        return docs
    chosen = placed if every else placed.where("in_mix")
    return chosen.select("row", "position").repartitionByRange("position").sortWithinPartitions("position").select("row.*")
