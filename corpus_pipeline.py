"""A corpus pipeline of five stages, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellrank.llm import bpe, classifier, mixing
from dwellrank.llm.blocks import kept_documents
from dwellrank.llm.common import shared_path, written
from dwellrank.llm.jaccard import jaccard_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the classifier, fitted on the labelled ones of these documents, does not reject."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.mapInArrow(classifier.accepting(spark, model, docs.columns.index("text")), docs.schema)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that shingle similarity links, and all documents without an id."""
    stays = jaccard_components(docs.where("doc_id is not null")).where("doc_id = component_id").select(F.col("doc_id").alias("__stays"))
    return docs.join(stays, docs["doc_id"] == F.col("__stays"), "left_semi").union(docs.where("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sources interleaved at shares that go with the square roots of their sizes; who runs out drops out of the order."""
    return mixing.mixture(docs, every=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's encoding and of its decoding, and ``start``: the tokens of all documents before it in the mixture.

    The mixture's order is that of its files, and of the rows in each. A file's rows are summed up in one task, the files by their totals.
    """
    row, file = F.col("_metadata.row_index"), F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    placed = docs.select("doc_id", "text", (F.shiftleft(file, 40) + row).alias("__place"))
    coded = bpe.encode(placed, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, id_col="__place").withColumnRenamed("doc_id", "__place")
    coded = written(coded.withColumn("__file", F.shiftright("__place", 40)), "pipeline-coded")
    files = coded.groupBy("__file").agg(F.sum("n_tokens").alias("__all"))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("__file", before(Window.orderBy("__file"), "__all").alias("__before"))
    inside = before(Window.partitionBy("__file").orderBy("__place"), "n_tokens")
    coded = coded.withColumn("__inside", inside).join(files, "__file").withColumn("start", F.col("__before") + F.col("__inside"))
    return coded.join(placed.select("doc_id", "__place"), "__place").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "start")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]
ORACLE_SQL = None  # neither the classifier nor the tokenizer can be stated in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
