"""Prompts and answers for retrieval results, with resume by output key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dwellrank.functions.conditions import BARE_MODEL
from dwellrank.functions.models import predict_answer
from dwellrank.functions.prompts import bare_prompt, mcqa_prompt

KEYS = ("condition", "example_id", "reader_id")


def prediction_key() -> Column:
    """The key as a JSON list, for file names and messages."""
    return F.to_json(F.array(*KEYS), {"ignoreNullFields": "false"})


def evidence_texts(ranked_chunks: Column, evidence: Column) -> Column:
    """Texts of the evidence items, the chunk ids where there are none."""
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, F.transform(evidence, lambda e: e["text"])).otherwise(
        F.transform(ranked_chunks, lambda c: c["chunk_id"])
    )


def join_questions(retrievals: DataFrame, questions: DataFrame, strict: bool = True) -> DataFrame:
    """Retrieval results with their question (J9); a missing question is an error."""
    joined = retrievals.join(questions.withColumn("_found", F.lit(True)), "example_id", "left" if strict else "inner")
    if strict:
        absent = F.raise_error(F.concat(F.lit("no question for example "), F.col("example_id"))).cast("string")
        joined = joined.withColumn("question", F.when(F.col("_found"), F.col("question")).otherwise(absent))
    return joined.drop("_found")


def requests(retrievals: DataFrame | None, questions: DataFrame, include_bare: bool = False) -> DataFrame:
    """Prompts of all results and, when asked for, of the model without evidence."""
    parts = []
    if include_bare:
        parts.append(questions.select(
            F.lit(BARE_MODEL).alias("condition"), "example_id", F.lit(None).cast("string").alias("reader_id"),
            bare_prompt(F.col("question"), F.col("choices")).alias("prompt"), "choices", "answer_index", "choice_shuffle",
        ))
    if retrievals is not None:
        texts = evidence_texts(F.col("ranked_chunks"), F.col("metadata.evidence"))
        parts.append(join_questions(retrievals, questions).select(
            "condition", "example_id", "reader_id",
            mcqa_prompt(F.col("question"), F.col("choices"), texts).alias("prompt"),
            "choices", "answer_index", "choice_shuffle",
        ))
    if not parts:
        raise ValueError("neither retrieval results nor the bare model were requested")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def pending(wanted: DataFrame, done: DataFrame | None) -> DataFrame:
    """Requests without an output row yet (J16); reader keys compare null-safe."""
    if done is None:
        return wanted
    keys = done.select(*[F.col(k).alias(f"_{k}") for k in KEYS])
    on = (
        (F.col("condition") == F.col("_condition")) & (F.col("example_id") == F.col("_example_id"))
        & F.col("reader_id").eqNullSafe(F.col("_reader_id"))
    )
    return wanted.join(keys, on, "left_anti")


def answer(wanted: DataFrame, mode: str = "generate", **models) -> DataFrame:
    """Predictions of all requests (M6)."""
    out = wanted.withColumn("_p", predict_answer(F.col("prompt"), F.col("choices"), mode, **models))
    return out.select(
        "example_id", "reader_id", "condition", "prompt", F.col("_p.raw_output").alias("raw_output"),
        F.col("_p.predicted_index").alias("predicted_index"), F.col("answer_index").alias("gold_index"),
        F.struct(F.lit(mode).alias("scoring_mode"), "choice_shuffle").alias("metadata"),
    )


def check_resume(done: DataFrame, enabled: bool, seed: int) -> None:
    """Refuse to add to predictions made with another choice shuffle."""
    first = done.select("metadata.choice_shuffle.enabled", "metadata.choice_shuffle.seed").take(1)
    if not first:
        return
    found = (bool(first[0]["enabled"]), first[0]["seed"])
    if found != (enabled, seed if enabled else None):
        raise ValueError(
            "the existing predictions were made with a different choice shuffle; overwrite them or use a new folder"
        )
