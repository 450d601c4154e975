"""Positions and top shares of groups that may hold a large part of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def position_in_group(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """0-based position of every row in its group's order.

    ``bucket`` must grow with the order. Rows are ranked inside their bucket,
    and the rows of earlier buckets are counted from one row per bucket, so no
    task orders a whole group.
    """
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    placed = rows.withColumn("_in", F.row_number().over(inside) - 1).join(base, [*keys, "_bucket"])
    return placed.withColumn(name, (F.col("_base") + F.col("_in")).cast("bigint")).drop("_bucket", "_in", "_base")


def top_share_sum(df: DataFrame, keys: list[str], value: str, top_percent: float, sketch: int = 1000) -> DataFrame:
    """Sum of the largest ceil(p·n) values per group, at least one (A8, long form).

    A mergeable sketch brackets the smallest value that still counts. What lies
    above the bracket is summed as it is; only the distinct values inside the
    bracket are ordered.
    """
    if not 0 < top_percent <= 1:
        raise ValueError("top_percent must satisfy 0 < top_percent <= 1")
    slack = 2.0 / sketch
    cut = [max(0.0, 1 - top_percent - slack), min(1.0, 1 - top_percent + slack)]
    finite = F.when(F.isnan(value) | (F.abs(F.col(value)) == float("inf")), F.lit(0.0)).otherwise(F.col(value))
    rows = df.select(*keys, F.coalesce(finite, F.lit(0.0)).alias("_v"))
    brackets = rows.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") * F.lit(float(top_percent)))).alias("_k"),
        F.percentile_approx("_v", cut, F.lit(sketch)).alias("_b"),
    ).select(*keys, "_k", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    kept = rows.join(brackets, keys).where(F.col("_v") >= F.col("_lo"))
    # one row per distinct value inside the bracket and one for everything above it
    counted = kept.groupBy(*keys, "_k", F.when(F.col("_v") <= F.col("_hi"), F.col("_v")).alias("_inside")).agg(
        F.count("*").alias("_n"), F.sum("_v").alias("_s")
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_inside").desc_nulls_first())
    counted = counted.withColumn("_left", F.col("_k") - F.sum("_n").over(order) + F.col("_n"))
    taken = F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_left")))
    part = F.when(F.col("_inside").isNull(), F.col("_s")).otherwise(F.col("_inside") * taken)
    sums = counted.groupBy(*keys).agg(F.sum(part).alias("concentration"), F.sum(taken).alias("_taken"), F.max("_k").alias("_k"))
    missed = F.raise_error(F.lit("the quantile bracket misses the cut")).cast("double")
    return sums.select(
        *keys, F.when(F.col("_taken") == F.col("_k"), F.col("concentration")).otherwise(missed).alias("concentration")
    )


def last_per_key(df: DataFrame, keys: list[str], ordinals: tuple[str, ...] = ("src_ordinal", "example_ordinal")) -> DataFrame:
    """One row per key, as a dictionary filled in source order keeps it (W9, O7): the last by the first of ``ordinals`` that ``df`` has.

    Without any the largest row counts, so that the choice does not depend on how rows are spread.
    """
    rest = [c for c in df.columns if c not in keys]
    by = next((F.col(c) for c in ordinals if c in df.columns), F.struct(*rest))
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in df.columns])
