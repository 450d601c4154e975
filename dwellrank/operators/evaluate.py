"""Accuracy, paired differences, retrieval overlap and gain analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellrank.functions.conditions import BARE_MODEL, GAIN_CONDITIONS
from dwellrank.functions.scores import jaccard, nan
from dwellrank.operators.ordering import last_per_key


def correctness() -> Column:
    """Equality of the two indices, null when either is missing."""
    return F.col("predicted_index") == F.col("gold_index")


def scored_only(predictions: DataFrame) -> DataFrame:
    """Rows with a parsed answer and a gold answer."""
    return predictions.where(F.col("predicted_index").isNotNull() & F.col("gold_index").isNotNull())


def last_wins(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The last row per key in source order (W9), combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def accuracy(predictions: DataFrame) -> DataFrame:
    """Overall accuracy, NaN when nothing is scored (A2)."""
    return predictions.agg(F.coalesce(F.avg(correctness().cast("double")), nan()).alias("accuracy"))


def accuracy_by_group(predictions: DataFrame) -> DataFrame:
    """Accuracy, counts and missing-parse rate per (condition, reader) (A1)."""
    return (
        predictions.where(F.col("gold_index").isNotNull())
        .groupBy("condition", "reader_id")
        .agg(
            F.avg(correctness().cast("double")).alias("accuracy"),
            F.count("*").alias("count"),
            F.count("predicted_index").alias("scored_count"),
            (F.lit(1.0) - F.avg(F.col("predicted_index").isNotNull().cast("double"))).alias("missing_parse_rate"),
        )
    )


def paired_rows(predictions: DataFrame, baseline: str, ordinal: str = "src_ordinal") -> DataFrame:
    """Every scored treatment row with its baseline partner.

    The partner is the baseline row of the same example and reader, else the
    baseline row of the example without a reader; rows without one are dropped.
    """
    flags = last_wins(
        scored_only(predictions).select(
            "condition", "example_id", "reader_id", correctness().cast("double").alias("correct"), ordinal
        ),
        ["condition", "example_id", "reader_id"],
        ordinal,
    )
    treated = flags.where(F.col("condition") != baseline).withColumnRenamed("correct", "correct_treatment").drop(ordinal)
    base = flags.where(F.col("condition") == baseline)
    exact = base.select(
        F.col("example_id").alias("_ex"), F.col("reader_id").alias("_rd"), F.col("correct").alias("_exact")
    )
    fallback = base.where(F.col("reader_id").isNull()).select("example_id", F.col("correct").alias("_fallback"))
    return (
        treated.join(exact, (F.col("example_id") == F.col("_ex")) & F.col("reader_id").eqNullSafe(F.col("_rd")), "left")
        .join(fallback, "example_id", "left")
        .withColumn("correct_baseline", F.coalesce("_exact", "_fallback"))
        .where(F.col("correct_baseline").isNotNull())
        .select(
            "condition", "example_id", "reader_id", "correct_treatment", "correct_baseline",
            (F.col("correct_treatment") - F.col("correct_baseline")).alias("delta"),
        )
    )


def delta_statistics(delta: str = "delta") -> list[Column]:
    """n, mean, standard error and normal 95% interval; NaN for n = 0, zero error for n = 1 (A3)."""
    n = F.count(delta)
    mean = F.coalesce(F.avg(delta), nan())
    error = F.when(n == 0, nan()).when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(delta) / F.sqrt(n))
    return [
        n.alias("n"),
        mean.alias("mean_delta"),
        error.alias("standard_error"),
        (mean - 1.96 * error).alias("ci95_low"),
        (mean + 1.96 * error).alias("ci95_high"),
    ]


def paired_deltas(predictions: DataFrame, baseline: str, ordinal: str = "src_ordinal") -> DataFrame:
    """One row per non-baseline condition, all in a single pass (A4).

    A condition without any pair keeps its row with n = 0.
    """
    treatments = predictions.where(F.col("condition") != baseline).select("condition").distinct()
    stats = treatments.join(
        paired_rows(predictions, baseline, ordinal), "condition", "left"
    ).groupBy("condition").agg(*delta_statistics())
    return stats.select(F.lit(baseline).alias("baseline"), F.col("condition").alias("treatment"), *[
        c for c in stats.columns if c != "condition"
    ])


def compare_conditions(predictions: DataFrame, baseline: str, treatment: str, ordinal: str = "src_ordinal") -> DataFrame:
    """Statistics of one treatment against the baseline, always one row."""
    rows = paired_rows(predictions.where(F.col("condition").isin(baseline, treatment)), baseline, ordinal)
    stats = rows.agg(*delta_statistics())
    return stats.select(F.lit(baseline).alias("baseline"), F.lit(treatment).alias("treatment"), "*")


def default_baseline(predictions: DataFrame) -> str:
    """"text" when present, else the bare model."""
    return "text" if predictions.where(F.col("condition") == "text").take(1) else BARE_MODEL


def chunk_sets(evidence: DataFrame) -> DataFrame:
    """Chunk-id set and best chunk per (condition, example, reader) of a ranked long relation."""
    return evidence.groupBy("condition", "example_id", "reader_id").agg(
        F.collect_set("chunk_id").alias("chunks"), F.min_by("chunk_id", "rank").alias("top_chunk")
    )


def retrieval_overlap(results: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Jaccard of every non-text result with its example's text result.

    ``results`` has condition, example_id, reader_id, chunks, top_chunk. Without
    an ordinal the text rows are taken as unique per example.
    """
    text = results.where(F.col("condition") == "text").select(
        "example_id", F.col("chunks").alias("text_chunks"), *([ordinal] if ordinal else [])
    )
    if ordinal:
        text = last_wins(text, ["example_id"], ordinal).drop(ordinal)
    return (
        results.where(F.col("condition") != "text")
        .join(text, "example_id", "left")
        .select(
            "example_id", "reader_id", "condition",
            jaccard(F.col("chunks"), F.col("text_chunks")).alias("jaccard_vs_text"),
            "top_chunk",
        )
    )


def overlap_by_condition(overlap: DataFrame) -> DataFrame:
    """Count, mean, min and max of the overlap per condition."""
    value = "jaccard_vs_text"
    return overlap.groupBy("condition").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


def results_per_condition(results: DataFrame) -> DataFrame:
    """Number of results per condition."""
    return results.groupBy("condition").agg(F.count("*").alias("records"))


def gain_rows(
    predictions: DataFrame, results: DataFrame, statistics: DataFrame | None = None, ordinal: str = "src_ordinal"
) -> DataFrame:
    """Where reading data changes the answer.

    The text partner is looked up without a reader first, then with the reader:
    the reverse of the paired statistics. The last prediction per key counts
    before unscored ones are dropped, and so does the last result and the last
    statistics row. Statistics columns replace equal names.
    """
    keys = ["example_id", "reader_id"]
    latest = last_wins(
        predictions.select("condition", *keys, correctness().cast("int").alias("correct"), ordinal),
        ["condition", *keys], ordinal,
    ).drop(ordinal)
    gaze = latest.where(F.col("condition").isin(*GAIN_CONDITIONS)).withColumnRenamed("correct", "treatment_correct")
    text = latest.where(F.col("condition") == "text")
    without = text.where(F.col("reader_id").isNull()).select(
        "example_id", F.struct("correct").alias("_without")
    )
    with_reader = text.where(F.col("reader_id").isNotNull()).select(*keys, F.struct("correct").alias("_with"))
    rows = (
        gaze.join(without, "example_id", "left").join(with_reader, keys, "left")
        .withColumn("text_correct", F.coalesce("_without", "_with")["correct"])
        .where(F.col("treatment_correct").isNotNull() & F.col("text_correct").isNotNull())
    )
    results = last_per_key(results, ["condition", *keys])
    own = results.select(
        F.col("condition").alias("_c"), F.col("example_id").alias("_e"), F.col("reader_id").alias("_r"),
        F.col("chunks").alias("_own"),
    )
    text_results = last_per_key(results.where(F.col("condition") == "text").drop("reader_id"), ["example_id"])
    text_results = text_results.select("example_id", F.col("chunks").alias("_text"))
    rows = (
        rows.join(
            own,
            (F.col("condition") == F.col("_c")) & (F.col("example_id") == F.col("_e"))
            & F.col("reader_id").eqNullSafe(F.col("_r")),
            "left",
        )
        .join(text_results, "example_id", "left")
        .select(
            *keys, "condition",
            (F.col("treatment_correct") - F.col("text_correct")).alias("delta_vs_text"),
            "treatment_correct", "text_correct",
            jaccard(F.col("_own"), F.col("_text")).alias("retrieval_jaccard_vs_text"),
        )
    )
    if statistics is None:
        return rows
    extra = [c for c in statistics.columns if c not in keys]
    right = last_per_key(statistics, keys).select(
        F.col("example_id").cast("string").alias("_e"), F.col("reader_id").alias("_r"),
        *[F.col(c).alias(f"_s_{c}") for c in extra], F.lit(True).alias("_hit"),
    )
    joined = rows.join(
        right, (F.col("example_id") == F.col("_e")) & F.col("reader_id").eqNullSafe(F.col("_r")), "left"
    )

    def pick(c: str) -> Column:
        if c not in rows.columns:
            return F.col(f"_s_{c}").alias(c)
        return F.when(F.col("_hit"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) if c in extra else F.col(c)

    return joined.select(*[pick(c) for c in rows.columns], *[pick(c) for c in extra if c not in rows.columns])
