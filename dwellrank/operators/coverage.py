"""How well retrieved chunks cover the gold spans of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellrank.functions.conditions import HYBRID_HEAD, POOL_MAXSIM, RERANK_HEAD, RERANK_TAIL
from dwellrank.functions.text import span_words_to_chars, word_spans
from dwellrank.operators.ordering import last_per_key

FLAGS = ("any_overlap", "any_full", "all_full")


def gold_spans(articles: DataFrame) -> DataFrame:
    """Word-index spans of every question as character spans.

    ``articles`` has example_id, level, paragraph_text, a_indices, d_indices.
    """
    spans = articles.withColumn("_words", word_spans(F.col("paragraph_text")))
    return spans.select(
        "example_id", "level",
        span_words_to_chars(F.col("_words"), F.col("a_indices")).alias("a_spans"),
        span_words_to_chars(F.col("_words"), F.col("d_indices")).alias("d_spans"),
    )


def _overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (b["end"] > a["start"])


def _contains(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (outer["end"] >= inner["end"])


def coverage_flags(intervals: Column, spans: Column) -> dict[str, Column]:
    """any_overlap, any_full and all_full as 0/1 (J15); no span at all counts as all_full."""
    flags = {
        "any_overlap": F.exists(spans, lambda s: F.exists(intervals, lambda i: _overlaps(i, s))),
        "any_full": F.exists(spans, lambda s: F.exists(intervals, lambda i: _contains(i, s))),
        "all_full": F.forall(spans, lambda s: F.exists(intervals, lambda i: _contains(i, s))),
    }
    return {name: flag.cast("int") for name, flag in flags.items()}


def is_composite_condition(c: Column) -> Column:
    return (
        c.startswith(HYBRID_HEAD) | (c.startswith(RERANK_HEAD) & c.endswith(RERANK_TAIL)) | (c == F.lit(POOL_MAXSIM))
    )


def resolve_intervals(evidence: DataFrame, records: DataFrame, strict: bool = True) -> DataFrame:
    """Character interval of every retrieved chunk.

    Taken from the evidence itself, else from the embedding record of the same
    condition; composite conditions then try the reader's actual_gaze record
    and the text record. Of records with one key the last counts (O7).
    """
    interval = lambda c: F.struct(c["char_start"].cast("int").alias("start"), c["char_end"].cast("int").alias("end"))
    own = F.when(F.col("char_start").isNotNull() & F.col("char_end").isNotNull(), interval({c: F.col(c) for c in ("char_start", "char_end")}))
    attempt = lambda n, condition, reader: F.struct(F.lit(n).alias("n"), condition.cast("string").alias("c"), reader.cast("string").alias("r"))
    none = F.lit(None).cast("string")
    first = attempt(1, F.col("condition"), F.col("reader_id"))
    others = F.array(attempt(2, F.lit("actual_gaze"), F.col("reader_id")), attempt(3, F.lit("text"), none))
    tries = F.when(own.isNotNull(), F.array(attempt(0, none, none))).when(is_composite_condition(F.col("condition")), F.concat(F.array(first), others)).otherwise(F.array(first))
    # every row asks for its records in the order of preference; one join answers all, and the row's best answer counts
    asked = evidence.select("*", own.alias("_own"), F.explode(tries).alias("_t"))
    known = last_per_key(records, ["condition", "example_id", "reader_id", "chunk_id"]).select(
        F.col("condition").alias("_c"), F.col("example_id").alias("_e"), F.col("reader_id").alias("_r"), F.col("chunk_id").alias("_k"),
        interval({c: F.col(c) for c in ("char_start", "char_end")}).alias("_found"),
    )
    on = (F.col("_t.c") == F.col("_c")) & (F.col("example_id") == F.col("_e")) & (F.col("chunk_id") == F.col("_k")) & F.col("_t.r").eqNullSafe(F.col("_r"))
    answer = F.coalesce("_own", "_found")
    best = F.min(F.when(answer.isNotNull(), F.struct(F.col("_t.n").alias("n"), answer.alias("interval"))))
    rows = asked.join(known, on, "left").groupBy(*evidence.columns).agg(best["interval"].alias("interval"), F.count_if(F.col("_t.n") <= 1).alias("_copies"))
    if strict:
        absent = F.raise_error(F.concat(F.lit("no chunk record for "), F.col("chunk_id")))
        rows = rows.withColumn("interval", F.coalesce("interval", absent.cast("struct<start:int,end:int>")))
    # rows that are alike in everything are one group
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")).drop("_copies", "_copy")


def span_coverage(evidence: DataFrame, gold: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Coverage flags per result and cutoff.

    ``evidence`` is a ranked relation with ``interval``; a result's intervals
    are collected once (at most k of them) and cut for every cutoff.
    """
    if any(k <= 0 for k in cutoffs):
        raise ValueError("cutoffs must be positive")
    results = evidence.groupBy("condition", "example_id", "reader_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "interval"))).alias("_ranked")
    )
    joined = results.join(last_per_key(gold, ["example_id"]), "example_id", "left")
    joined = joined.withColumn(
        "level",
        F.when(F.col("a_spans").isNotNull(), F.col("level")).otherwise(
            F.raise_error(F.concat(F.lit("no gold spans for example "), F.col("example_id"))).cast("string")
        ),
    )
    cut = joined.select("*", F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("top_k")).withColumn(
        "_intervals", F.transform(F.slice("_ranked", F.lit(1), F.col("top_k")), lambda r: r["interval"])
    )
    flags = [
        flag.alias(f"{side}_{name}")
        for side in ("a", "d")
        for name, flag in coverage_flags(F.col("_intervals"), F.col(f"{side}_spans")).items()
    ]
    return cut.select(
        "example_id", "reader_id", "condition", "level", "top_k",
        F.size("_ranked").alias("available_ranked_chunks"), *flags,
    )


def coverage_summary(detail: DataFrame) -> DataFrame:
    """Mean of the six flags per (condition, cutoff) (A10)."""
    return detail.groupBy("condition", "top_k").agg(
        F.count("*").alias("count"),
        *[F.avg(f"{side}_{name}").alias(f"{side}_{name}") for side in ("a", "d") for name in FLAGS],
    )
