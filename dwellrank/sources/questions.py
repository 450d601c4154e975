"""Question sources: nested article JSON, flat tables and their fallbacks."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dwellrank.functions.arrays import explode_rows
from dwellrank.functions.text import SPACE, U
from dwellrank.operators.choices import qa_from_table, shuffle_choices
from dwellrank.operators.gaze_table import paragraph_id_of_article
from dwellrank.schemas import ARTICLE, ARTICLE_DDL, CHOICE_SHUFFLE
from dwellrank.sources.gaze import _exists, require

# Where a question file is looked for when the dataset cannot be loaded.
FALLBACK_VARIABLE = "ONESTOP_QA_JSON"
FALLBACK_PATHS = ("resources/onestop_qa.json", "OneStop-Eye-Movements/data_preprocessing/onestop_qa.json")
LEVEL_DDL = "struct<context:string,a_spans:array<array<int>>,d_spans:array<array<int>>>"
QUESTION_DDL = "struct<q_ind:string,question:string,answers:array<string>>"
NOT_LEVELS = ("paragraph_id", "qas")


def read_articles(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Articles with paragraphs as key → raw JSON maps (level names are data).

    ``lines`` reads one article per line, which splits over tasks. One JSON
    document is a list of articles or ``{"data": [...]}``.
    """
    require(spark, path)
    if lines:
        return _numbered(spark.read.schema(ARTICLE_DDL).json(path), None)
    item = ARTICLE
    whole = spark.read.text(path, wholetext=True).select(
        F.when(
            F.col("value").rlike(rf"{U}\A{SPACE}*\["), F.from_json("value", f"array<{item}>")
        ).otherwise(F.from_json("value", f"struct<data:array<{item}>>")["data"]).alias("articles")
    )
    checked = F.when(F.col("articles").isNotNull(), F.col("articles")).otherwise(
        F.raise_error(F.lit("the question file holds neither a list nor a top-level data list")).cast(f"array<{item}>")
    )
    return whole.select(F.posexplode(checked).alias("article_ordinal", "a")).select("article_ordinal", "a.*")


def _numbered(articles: DataFrame, ordinal: Column | None) -> DataFrame:
    order = F.monotonically_increasing_id() if ordinal is None else ordinal
    return articles.select(order.alias("article_ordinal"), *articles.columns)


def question_rows(articles: DataFrame) -> DataFrame:
    """article × paragraph × level × question (S5, J18), all inside one row's arrays.

    Levels are the paragraph's keys that hold an object; their order is the
    file's order.
    """
    paragraphs = articles.select("article_ordinal", "article_id", "title", F.posexplode("paragraphs").alias("p_pos", "p"))
    levels = paragraphs.select(
        "article_ordinal", "article_id", "title", "p_pos",
        F.col("p")["paragraph_id"].alias("paragraph_number"),
        F.from_json(F.col("p")["qas"], "array<string>").alias("qas"),
        F.filter(F.map_entries("p"), lambda e: ~e["key"].isin(*NOT_LEVELS) & e["value"].startswith("{")).alias("levels"),
    )
    kept = [c for c in levels.columns if c != "levels"]
    levels = explode_rows(levels, kept, F.col("levels"), "l_pos", "l")
    parsed = levels.select(
        "*", F.col("l.key").alias("level"), F.from_json("l.value", LEVEL_DDL).alias("body")
    ).drop("l")
    return parsed.select(
        "article_ordinal", "article_id", "title", "p_pos", "paragraph_number", "l_pos", "level", "body",
        F.posexplode("qas").alias("q_pos", "raw_qa"),
    ).withColumn("qa", F.from_json("raw_qa", QUESTION_DDL))


def example_id_of(article: Column, paragraph: Column, level: Column, question: Column) -> Column:
    return F.concat_ws(":", F.lit("local"), article, F.coalesce(paragraph, F.lit("None")), level, F.coalesce(question, F.lit("None")))


def qa_from_articles(articles: DataFrame, source: str = "", seed: int = 13, shuffle: bool = False) -> DataFrame:
    """QA rows of nested articles (S5): blank contexts are skipped, missing answers are an error."""
    rows = question_rows(articles).where(F.length("body.context") > 0)
    answers = F.col("qa.answers")
    choices = F.when(F.size(answers) > 0, answers).otherwise(
        F.raise_error(F.concat(F.lit("a question has no answers: "), F.col("raw_qa"))).cast("array<string>")
    )
    paragraph, q = F.coalesce("paragraph_number", F.lit("None")), F.coalesce("qa.q_ind", F.lit("None"))
    out = rows.select(
        F.struct("article_ordinal", "p_pos", "l_pos", "q_pos").alias("source_position"),
        example_id_of(F.col("article_id"), paragraph, F.col("level"), q).alias("example_id"),
        paragraph_id_of_article(F.col("article_id"), paragraph, F.col("level"), q).alias("paragraph_id"),
        F.col("body.context").alias("paragraph_text"),
        F.col("qa.question").alias("question"),
        choices.alias("choices"),
        F.lit(0).alias("answer_index"),
        F.struct(
            F.lit(source).alias("source"), F.lit(None).cast("string").alias("split"), F.col("article_id"),
            F.col("title").alias("article_title"), F.col("paragraph_number"), F.col("level").alias("difficulty_level"),
            F.col("raw_qa"), F.lit(None).cast("string").alias("raw"),
            F.lit(None).cast(CHOICE_SHUFFLE).alias("choice_shuffle"),
        ).alias("metadata"),
    )
    return shuffle_choices(out, seed, shuffle)


def with_ordinals(qa: DataFrame, position: str = "source_position") -> DataFrame:
    """Adds ``example_ordinal``, the 0-based rank of the source position.

    The rank is the rank inside the article plus the number of questions of
    earlier articles. That running count is taken per bucket of 4096 articles,
    so only one row per bucket is ever ordered in one place.
    """
    article = F.col(f"{position}.article_ordinal")
    sizes = qa.groupBy(article.alias("_article")).agg(F.count("*").alias("_n")).withColumn(
        "_bucket", F.shiftright("_article", 12)
    )
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = sizes.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    buckets = buckets.select("_bucket", earlier(Window.orderBy("_bucket")).alias("_base"))
    offsets = sizes.withColumn("_within", earlier(Window.partitionBy("_bucket").orderBy("_article"))).join(
        buckets, "_bucket"
    ).select("_article", (F.col("_base") + F.col("_within")).alias("_offset"))
    in_article = F.row_number().over(Window.partitionBy("_article").orderBy(position)) - 1
    return (
        qa.withColumn("_article", article).withColumn("_in", in_article).join(offsets, "_article")
        .withColumn("example_ordinal", F.col("_offset") + F.col("_in"))
        .drop("_article", "_in", "_offset", position)
    )


def read_local_questions(spark: SparkSession, path: str, shuffle: bool = False, seed: int = 13, lines: bool = False) -> DataFrame:
    return qa_from_articles(read_articles(spark, path, lines), path, seed, shuffle)


def fallback_path() -> str | None:
    """Question file named by the environment, else the first default that exists."""
    named = os.environ.get(FALLBACK_VARIABLE)
    return named or next((p for p in map(os.path.abspath, FALLBACK_PATHS) if os.path.exists(p)), None)


def read_questions(
    spark: SparkSession, dataset: str, split: str | None = None, shuffle: bool = False, seed: int = 13,
    connector: Callable[[str, str | None], DataFrame] | None = None,
) -> DataFrame:
    """A local article file, else an exported dataset, else the fallback file.

    ``connector(dataset, split)`` gives the flat table with ``example_ordinal``;
    any failure of it leads to the fallback.
    """
    if _exists(spark, dataset):
        return read_local_questions(spark, dataset, shuffle, seed)
    try:
        if connector is None:
            raise RuntimeError("no connector for named datasets")
        return shuffle_choices(qa_from_table(connector(dataset, split), dataset, split), seed, shuffle)
    except Exception as failure:
        path = fallback_path()
        if path is None:
            raise RuntimeError(f"cannot load dataset {dataset!r} and there is no local fallback") from failure
        return read_local_questions(spark, path, shuffle, seed)


def exported_dataset(spark: SparkSession, root: str) -> Callable[[str, str | None], DataFrame]:
    """Connector for datasets exported as <root>/<dataset>/<split> Parquet files."""

    def load(dataset: str, split: str | None) -> DataFrame:
        return spark.read.parquet(f"{root}/{dataset}/{split or 'train'}")

    return load


def gold_span_rows(articles: DataFrame) -> DataFrame:
    """Questions with their word-index spans, picked by the question's index."""
    rows = question_rows(articles)
    q = F.col("qa.q_ind").cast("int")
    return rows.select(
        example_id_of(F.col("article_id"), F.col("paragraph_number"), F.col("level"), F.col("qa.q_ind")).alias("example_id"),
        "level",
        F.coalesce("body.context", F.lit("")).alias("paragraph_text"),
        F.element_at("body.a_spans", q + 1).alias("a_indices"),
        F.element_at("body.d_spans", q + 1).alias("d_indices"),
    )


def inspect_questions(qa: DataFrame, order: str = "example_id") -> DataFrame:
    """Count and first example with a 240-character text prefix and metadata keys, one row."""
    keys = sorted(qa.schema["metadata"].dataType.names) if "metadata" in qa.columns else []
    first = F.struct(
        F.col(order).alias("_order"), "example_id", "paragraph_id",
        F.substr("paragraph_text", F.lit(1), F.lit(240)).alias("paragraph_text_prefix"), "question", "choices", "answer_index",
    )
    return qa.agg(F.count("*").alias("example_count"), F.min_by(first, F.col(order)).alias("f")).select(
        "example_count", *[F.col(f"f.{c}").alias(f"first_{c}") for c in ("example_id", "paragraph_id", "paragraph_text_prefix", "question", "choices", "answer_index")],
        F.array(*[F.lit(k) for k in keys]).alias("metadata_keys"),
    )
