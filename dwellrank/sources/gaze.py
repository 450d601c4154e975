"""Interest-area reports: CSV and zipped CSV scans, schema inspection."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwellrank.sources.stores import matching
from dwellrank.sources.zipped import ZippedCsv, member_header


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return found is not None and len(found) > 0


def require(spark: SparkSession, path: str) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return path


def read_interest_areas(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as text, pruned to ``columns``; ``src_ordinal`` is the source order.

    A plain CSV is split over tasks. Of archives (``.zip``, a name or a glob)
    every member is read by one task as it is inflated, so its memory does not
    grow with the archive.
    """
    if path.endswith(".zip"):
        return _read_zipped(spark, path, columns)
    require(spark, path)
    header = list(spark.read.option("escape", '"').csv(path).first())
    schema = ", ".join(f"`{n}` string" for n in distinct_names(header))
    # every file's header is held against the first one's, unless repeated names had to be changed
    enforced = distinct_names(header) != header
    df = spark.read.option("header", True).option("enforceSchema", enforced).option("escape", '"').schema(schema).csv(path)
    order = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    names = picked_names(header, columns)
    return df.select(*[F.col(f"`{c}`") for c in names], order.alias("src_ordinal"))


def distinct_names(header: list[str]) -> list[str]:
    """Column names that stay apart without regard to case: a repeated one gets "_2"."""
    seen, out = set(), []
    for name in header:
        out.append(f"{name}_2" if name.lower() in seen else name)
        seen.add(name.lower())
    return out


def picked_names(header: list[str], columns: list[str] | None) -> list[str]:
    """Distinct names of the wanted raw columns; an absent column is an error."""
    absent = [c for c in columns or [] if c not in header]
    if absent:
        raise ValueError(f"columns not in the file: {absent}")
    unique = distinct_names(header)
    return unique if columns is None else [unique[header.index(c)] for c in columns]


def _read_zipped(spark: SparkSession, path: str, columns: list[str] | None) -> DataFrame:
    header = member_header(matching(path, ".zip")[0])
    names = picked_names(header, columns)
    schema = ", ".join(f"`{n}` string" for n in names) + ", src_ordinal struct<file:string,block:bigint,row:bigint>"
    spark.dataSource.register(ZippedCsv)
    options = {"path": path, "header": json.dumps(header), "columns": json.dumps(columns or [])}
    return spark.read.format("zipped_csv").schema(schema).options(**options).load()


def write_zipped_csv(df: DataFrame, path: str) -> None:
    """A folder of zipped CSV files with headers, one for each partition; null is empty."""
    df.sparkSession.dataSource.register(ZippedCsv)
    df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).write.format("zipped_csv").mode("overwrite").option("path", path).save()


def inspect_interest_areas(df: DataFrame) -> DataFrame:
    """Row and column counts with column names and types, one row (S3)."""
    columns = [c for c in df.columns if c != "src_ordinal"]
    types = dict(df.dtypes)
    return df.agg(F.count("*").alias("row_count")).select(
        "row_count",
        F.lit(len(columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in columns]).alias("columns"),
        F.array(*[F.lit(types[c]) for c in columns]).alias("dtypes"),
    )


def sample_interest_areas(df: DataFrame, n: int = 25) -> DataFrame:
    """The first rows in source order (S3)."""
    return df.orderBy("src_ordinal").limit(n).drop("src_ordinal")
