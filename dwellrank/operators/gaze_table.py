"""Raw interest-area rows to canonical gaze rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellrank.schemas import GAZE_META_COLUMNS, SchemaInferenceError

# Raw column names of the interest-area report.
REQUIRED = {
    "reader_id": "participant_id",
    "article_batch": "article_batch",
    "article_id": "article_id",
    "paragraph_id": "paragraph_id",
    "difficulty_level": "difficulty_level",
    "question_id": "onestopqa_question_id",
    "word_index": "IA_ID",
    "word": "IA_LABEL",
    "trt": "IA_DWELL_TIME",
}
SCAN_COLUMNS = tuple(
    dict.fromkeys(
        [*REQUIRED.values(), "IA_FIXATION_COUNT", "IA_SKIP"]
        + [c.replace("TRIAL_INDEX_2", "TRIAL_INDEX") for c in GAZE_META_COLUMNS]
    )
)


def _as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def composite_paragraph_id(batch: Column, article: Column, paragraph: Column, level: Column, question: Column) -> Column:
    """batch=…|article=…|paragraph=…|level=…|question=… with "nan" for nulls."""
    parts = zip(("batch", "article", "paragraph", "level", "question"), (batch, article, paragraph, level, question))
    return F.concat_ws("|", *[F.concat(F.lit(f"{name}="), _as_text(value)) for name, value in parts])


def paragraph_id_of_article(article_id: Column, paragraph: Column, level: Column, question: Column) -> Column:
    """The same key on the question side: "1_2" is batch 1, article 2."""
    has_batch = article_id.contains("_")
    return composite_paragraph_id(
        F.when(has_batch, F.substring_index(article_id, "_", 1)).otherwise(F.lit("")),
        F.when(has_batch, F.regexp_replace(article_id, r"\A[^_]*_", "")).otherwise(article_id),
        paragraph, level, question,
    )


def _is_false(c: Column) -> Column:
    return F.lower(c.cast("string")) == "false"


def drop_practice(df: DataFrame, include_practice: bool = False) -> DataFrame:
    """Keep rows whose practice flag is false; a null flag is dropped."""
    if include_practice or "practice_trial" not in df.columns:
        return df
    return df.where(_is_false(F.col("practice_trial")))


def drop_repeated(df: DataFrame, exclude_repeated: bool = False) -> DataFrame:
    """Keep first readings only when asked for (P5)."""
    if not exclude_repeated or "repeated_reading_trial" not in df.columns:
        return df
    return df.where(_is_false(F.col("repeated_reading_trial")))


def normalize_gaze(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Canonical gaze rows.

    The word index must be a number, a bad reading time counts 0, bad counts
    are null. ``src_ordinal`` keeps the source order: the given column, or a
    number that grows with file position.
    """
    missing = [c for c in REQUIRED.values() if c not in df.columns]
    if missing:
        raise SchemaInferenceError(f"missing interest-area columns: {missing}")

    def optional(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("double")
        value = F.col(name).try_cast("double")
        return F.when(F.isnan(value), None).otherwise(value)

    trt = F.col("IA_DWELL_TIME").try_cast("double")
    return df.select(
        _as_text(F.col("participant_id")).alias("reader_id"),
        composite_paragraph_id(
            *[F.col(c) for c in ("article_batch", "article_id", "paragraph_id", "difficulty_level", "onestopqa_question_id")]
        ).alias("paragraph_id"),
        F.col("IA_ID").cast("double").cast("int").alias("word_index"),
        _as_text(F.col("IA_LABEL")).alias("word"),
        F.coalesce(F.when(F.isnan(trt), None).otherwise(trt), F.lit(0.0)).alias("trt"),
        optional("IA_FIXATION_COUNT").alias("fixation_count"),
        optional("IA_SKIP").alias("skip"),
        (F.col(ordinal) if ordinal else F.monotonically_increasing_id()).alias("src_ordinal"),
        *[F.col(f"`{c}`").alias(f"metadata__{c}") for c in GAZE_META_COLUMNS if c in df.columns],
    )
