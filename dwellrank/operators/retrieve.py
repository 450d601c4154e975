"""Ranked evidence per question and reader.

Every ranking is ``row_number() <= k``: Spark keeps k rows per group in each
partition before the shuffle (WindowGroupLimit), so a group that holds a large
part of the data never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellrank.functions import conditions as names
from dwellrank.functions.vectors import as_double, dot, norm, normalize

CHUNK_COLUMNS = ("text", "char_start", "char_end")


def descending(score: Column) -> list[Column]:
    """Best score first, NaN last."""
    return [F.isnan(score).asc(), score.desc()]


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per group with their 1-based rank."""
    if k <= 0:
        raise ValueError("k must be positive")
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def embedding_id(df_example: Column, condition: Column, reader: Column, chunk: Column) -> Column:
    """example::condition::reader-or-none::chunk."""
    return F.concat_ws("::", df_example, condition, F.coalesce(reader, F.lit("none")), chunk)


def score_chunks(embeddings: DataFrame, queries: DataFrame, strict: bool = True) -> DataFrame:
    """Adds the cosine of every chunk vector with its question's vector.

    The small side of the join is Spark's choice by size; vectors leave the
    plan here, later joins and rankings carry scalars only.
    """
    unit = queries.select("example_id", normalize(as_double(F.col("qvec"))).alias("_q"))
    joined = embeddings.join(unit, "example_id", "left" if strict else "inner")
    if strict:
        absent = F.raise_error(F.concat(F.lit("no query vector for example "), F.col("example_id")))
        joined = joined.withColumn("_q", F.coalesce("_q", absent.cast("array<double>")))
    vec = as_double(F.col("vec"))
    length = norm(vec)
    score = F.when(length > 0, dot(vec, F.col("_q")) / length).otherwise(
        F.when(F.isnan(length), length).otherwise(F.lit(0.0))
    )
    return joined.withColumn("score", score).drop("vec", "_q")


def _ranked(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)


def retrieve_base(scored: DataFrame, k: int, tie: str = "embedding_id", digits: int | None = None) -> DataFrame:
    """Top k per (condition, example, reader); ties by id in text order."""
    return top_k(
        scored,
        ["condition", "example_id", "reader_id"],
        [*descending(_ranked(F.col("score"), digits)), F.col(tie)],
        k,
    )


def last_by_chunk(scored: DataFrame, keys: list[str], ordinal: str | None) -> DataFrame:
    """One row per key: the last in source order."""
    if ordinal is None:
        return scored
    rest = [c for c in scored.columns if c not in keys]
    return (
        scored.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])
    )


def pair_views(text_scored: DataFrame, gaze_scored: DataFrame, ordinal: str | None = None) -> DataFrame:
    """text_score and gaze_score of every chunk both views have.

    Text columns win; readerless gaze rows are left out.
    """
    keys = ["example_id", "chunk_id"]
    text = last_by_chunk(text_scored.where(F.col("reader_id").isNull()), keys, ordinal)
    gaze = last_by_chunk(gaze_scored.where(F.col("reader_id").isNotNull()), ["example_id", "reader_id", "chunk_id"], ordinal)
    left = text.select(
        *keys, F.col("score").alias("text_score"), *[F.col(c).alias(f"_text_{c}") for c in CHUNK_COLUMNS]
    )
    joined = gaze.withColumnRenamed("score", "gaze_score").join(left, keys)
    return joined.select(
        "example_id", "reader_id", "chunk_id", "text_score", "gaze_score",
        *[F.coalesce(f"_text_{c}", c).alias(c) for c in CHUNK_COLUMNS],
    )


def check_views(text_scored: DataFrame, gaze_scored: DataFrame) -> None:
    """Raise when a (question, reader) group shares no chunk with the text view."""
    groups = gaze_scored.where(F.col("reader_id").isNotNull()).select("example_id", "reader_id").distinct()
    shared = pair_views(text_scored, gaze_scored).select("example_id", "reader_id")
    lost = groups.join(shared, ["example_id", "reader_id"], "left_anti").take(1)
    if lost:
        raise ValueError(f"no shared chunks for example {lost[0][0]!r}, reader {lost[0][1]!r}")


def retrieve_hybrid(pairs: DataFrame, alpha: float, k: int, digits: int | None = None) -> DataFrame:
    """alpha·text + (1-alpha)·gaze."""
    names.check_alpha(alpha)
    score = F.lit(alpha) * F.col("text_score") + F.lit(1.0 - alpha) * F.col("gaze_score")
    scored = pairs.withColumn("score", score).withColumn("alpha", F.lit(float(alpha)))
    ranked = top_k(
        scored, ["example_id", "reader_id"],
        [*descending(_ranked(F.col("score"), digits)), F.col("chunk_id")], k,
    )
    return ranked.withColumn("condition", F.lit(names.hybrid_name(alpha)))


def retrieve_rerank(pairs: DataFrame, candidates: int, k: int, digits: int | None = None) -> DataFrame:
    """The best ``candidates`` chunks by text, re-ranked by gaze."""
    names.check_candidates(candidates, k)
    text, gaze = (_ranked(F.col(c), digits) for c in ("text_score", "gaze_score"))
    group = ["example_id", "reader_id"]
    first = top_k(pairs, group, [*descending(text), F.col("chunk_id")], candidates, "text_candidate_rank")
    ranked = top_k(first, group, [*descending(gaze), *descending(text), F.col("chunk_id")], k)
    return (
        ranked.withColumn("score", F.col("gaze_score"))
        .withColumn("candidate_top_n", F.lit(candidates))
        .withColumn("condition", F.lit(names.rerank_name(candidates)))
    )


def retrieve_pool(gaze_scored: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Best (reader, chunk) pairs over all readers (L8); a chunk may occur once per reader."""
    rows = gaze_scored.where(F.col("reader_id").isNotNull()).withColumnRenamed("reader_id", "selected_reader_id")
    ranked = top_k(
        rows, ["example_id"],
        [*descending(_ranked(F.col("score"), digits)), F.col("selected_reader_id"), F.col("chunk_id")], k,
    )
    return ranked.withColumn("reader_id", F.lit(None).cast("string")).withColumn("condition", F.lit(names.POOL_MAXSIM))


EVIDENCE_COLUMNS = {
    "chunk_id": "string", "text": "string", "score": "double", "char_start": "int", "char_end": "int",
    "text_score": "double", "gaze_score": "double", "alpha": "double", "text_candidate_rank": "int",
    "candidate_top_n": "int", "selected_reader_id": "string",
}


def to_evidence(ranked: DataFrame) -> DataFrame:
    """Long form with all evidence columns, absent extras null."""
    return ranked.select(
        "example_id", "reader_id", "condition", "rank",
        *[
            (F.col(c) if c in ranked.columns else F.lit(None)).cast(t).alias(c)
            for c, t in EVIDENCE_COLUMNS.items()
        ],
    )


FORMULA = {"hybrid": "alpha*text+(1-alpha)*gaze", "rerank": "text top-N candidates, reranked by gaze score",
           "pool": "max over reader/chunk q dot z_gaze"}


def nest_results(evidence: DataFrame) -> DataFrame:
    """One row per (example, reader, condition) with at most k evidence items."""
    item = F.struct("rank", *EVIDENCE_COLUMNS)
    nested = evidence.groupBy("example_id", "reader_id", "condition").agg(
        F.array_sort(F.collect_list(item)).alias("_items")
    )
    condition = F.col("condition")
    formula = (
        F.when(condition.startswith(names.HYBRID_HEAD), FORMULA["hybrid"])
        .when(condition.startswith(names.RERANK_HEAD) & condition.endswith(names.RERANK_TAIL), FORMULA["rerank"])
        .when(condition == names.POOL_MAXSIM, FORMULA["pool"])
    )
    first = F.get(F.col("_items"), F.lit(0))
    return nested.select(
        "example_id", "reader_id", "condition",
        F.transform("_items", lambda i: F.struct(i["chunk_id"].alias("chunk_id"), i["score"].alias("score"))).alias(
            "ranked_chunks"
        ),
        F.struct(
            F.transform("_items", lambda i: F.struct(*[i[c].alias(c) for c in EVIDENCE_COLUMNS])).alias("evidence"),
            first["alpha"].alias("alpha"),
            first["candidate_top_n"].alias("candidate_top_n"),
            first["selected_reader_id"].alias("selected_reader_id"),
            formula.alias("score_formula"),
        ).alias("metadata"),
    )


def result_lines(results: DataFrame) -> DataFrame:
    """Results for JSON lines: ranked chunks as [chunk_id, score] pairs of mixed types."""
    def pair(c: Column) -> Column:
        name = F.to_json(F.array(c["chunk_id"]))
        score = F.when(F.isnan(c["score"]), F.lit("null")).otherwise(c["score"].cast("string"))
        return F.parse_json(F.concat(F.substr(name, F.lit(1), F.length(name) - 1), F.lit(","), score, F.lit("]")))

    return results.withColumn("ranked_chunks", F.transform("ranked_chunks", pair))


def retrieve(
    scored: DataFrame, conditions: list[str], k: int = 3, digits: int | None = None, ordinal: str | None = None
) -> DataFrame:
    """All requested conditions in one long relation."""
    wanted = names.requested(conditions, top_k=k)
    base = [c for c in wanted if not names.is_composite(c)]
    parts = []
    if base:
        parts.append(to_evidence(retrieve_base(scored.where(F.col("condition").isin(base)), k, digits=digits)))
    text = scored.where(F.col("condition") == "text")
    gaze = scored.where(F.col("condition") == "actual_gaze")
    pairs = pair_views(text, gaze, ordinal)
    for name in wanted:
        if names.is_hybrid(name):
            parts.append(to_evidence(retrieve_hybrid(pairs, names.hybrid_alpha(name), k, digits)))
        elif names.is_rerank(name):
            parts.append(to_evidence(retrieve_rerank(pairs, names.rerank_candidates(name), k, digits)))
        elif names.is_pool(name):
            parts.append(to_evidence(retrieve_pool(gaze, k, digits)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def subset_embeddings(chunks: DataFrame, embeddings: DataFrame, strict: bool = True) -> DataFrame:
    """Embeddings of the listed chunks (J19); a chunk without one is an error."""
    if not strict:
        return embeddings.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    listed = chunks.select("chunk_id").distinct()
    joined = listed.join(embeddings, "chunk_id", "left")
    absent = F.raise_error(F.concat(F.lit("missing embedding for chunk "), F.col("chunk_id"))).cast("array<float>")
    return joined.withColumn("vec", F.coalesce("vec", absent))


def retrieve_text_only(
    chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, digits: int | None = None
) -> DataFrame:
    """Text view of the listed chunks, ties by chunk id (L3)."""
    view = (
        subset_embeddings(chunks, embeddings)
        .withColumn("condition", F.lit("text"))
        .withColumn("reader_id", F.lit(None).cast("string"))
    )
    return to_evidence(retrieve_base(score_chunks(view, queries), k, tie="chunk_id", digits=digits))


def retrieve_gaze_view(
    chunks: DataFrame, embeddings: DataFrame, queries: DataFrame, k: int, condition: str, digits: int | None = None
) -> DataFrame:
    """A reader's view of the listed chunks, three conditions only (L4)."""
    if condition not in names.GAIN_CONDITIONS:
        raise ValueError(f"unsupported gaze condition: {condition}")
    view = subset_embeddings(chunks, embeddings).withColumn("condition", F.lit(condition))
    return to_evidence(retrieve_base(score_chunks(view, queries), k, tie="chunk_id", digits=digits))
