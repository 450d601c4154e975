"""Reward pairs: context compression under a token budget, scoring and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwellrank.functions.arrays import let
from dwellrank.functions.prompts import reward_prompt
from dwellrank.functions.reading import heuristic_scores
from dwellrank.functions.scores import (
    COMPRESSION_CONDITIONS, FULL_CONTEXT, QUERY_ONLY, TRT_ONLY, combine_scores, compression_ratio, is_close, log1p_mean,
)
from dwellrank.functions.text import context_chunks, strip, word_count
from dwellrank.functions.vectors import dot
from dwellrank.operators.attention import hash_chunk_scores

SUPPORTED = (FULL_CONTEXT, *COMPRESSION_CONDITIONS)
SELECTED = "struct<index:int,start:int,end:int,score:double,text:string>"


def condition_budget_pairs(conditions: list[str], budgets: list[int]) -> list[tuple[str, int | None]]:
    """Every compressed condition with every budget, the full context once."""
    unknown = sorted(set(conditions) - set(SUPPORTED))
    if unknown:
        raise ValueError(f"unsupported conditions: {unknown}")
    if any(b <= 0 for b in budgets):
        raise ValueError("budgets must be positive")
    return [(c, b) for c in conditions for b in ([None] if c == FULL_CONTEXT else budgets)]


def needs_query_encoder(conditions: list[str]) -> bool:
    """Whether any condition compares chunks with the question."""
    return any(c in COMPRESSION_CONDITIONS and c != TRT_ONLY for c in conditions)


def needs_trt_predictor(conditions: list[str]) -> bool:
    """Whether any condition needs predicted reading times."""
    return any(c in COMPRESSION_CONDITIONS and c != QUERY_ONLY for c in conditions)


def row_id(given: Column, index: Column) -> Column:
    """The row's id, or its index when the id is missing or empty."""
    return F.coalesce(F.when(F.length(given.cast("string")) > 0, given.cast("string")), index.cast("string"))


def prediction_id(row: Column, condition: Column, budget: Column) -> Column:
    return F.concat(row, F.lit("::"), condition, F.lit("::budget="), F.coalesce(budget.cast("string"), F.lit("full")))


def select_rows(df: DataFrame, subsets: list[str] | None = None, max_examples: int | None = None) -> DataFrame:
    """Subset filter, then the first rows in source order (S14); row_index is the unfiltered index."""
    if subsets:
        df = df.where(F.col("subset").isin(*subsets))
    if max_examples is not None:
        df = df.orderBy("row_index").limit(max_examples)
    return df


def greedy_select(chunks: Column, scores: Column, costs: Column, budget: Column) -> Column:
    """Chunks taken by falling score while they fit the budget.

    The best chunk is always taken; a later smaller chunk may still fit after a
    larger one was passed over. The result is in text order.
    """
    items = F.array_sort(
        F.transform(
            F.arrays_zip(chunks.alias("c"), scores.alias("s"), costs.alias("k")),
            lambda z, i: F.struct(
                (-z["s"]).alias("order"), i.alias("index"), z["c"].alias("c"), z["s"].alias("s"), z["k"].alias("k")
            ),
        )
    )

    def consider(acc: Column, x: Column) -> Column:
        cost = F.greatest(F.lit(1), x["k"])
        fits = (acc["total"] + cost <= budget) | (F.size(acc["taken"]) == 0)
        item = F.struct(
            x["index"].alias("index"), x["c"]["start"].alias("start"), x["c"]["end"].alias("end"),
            x["s"].alias("score"), x["c"]["text"].alias("text"),
        )
        return F.when(
            fits,
            F.struct(
                (acc["total"] + cost).alias("total"), F.concat(acc["taken"], F.array(item)).alias("taken")
            ),
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("total"), F.array().cast(f"array<{SELECTED}>").alias("taken"))
    return F.aggregate(items, start, consider, lambda acc: F.array_sort(acc["taken"]))


def context_scores(rows: DataFrame, max_words: int = 80, dim: int = 128, encoder: Callable | None = None,
                   predictor: Callable | None = None, token_count: Callable[[Column], Column] = word_count) -> DataFrame:
    """Splits every context once and scores its chunks once.

    ``encoder(text, kind)`` and ``predictor(text)`` are Column functions for a
    unit vector and for an array of word reading times; the defaults are the
    hash encoder and the length heuristic.
    """
    texts = F.col("_chunks.text")
    if encoder is None:
        similarity = hash_chunk_scores(F.col("question"), texts, dim)
    else:
        similarity = let(encoder(F.col("question"), "query"), lambda q: F.transform(texts, lambda t: dot(q, encoder(t, "passage"))))
    own = heuristic_scores(texts)
    reading = own["score"] if predictor is None else F.transform(texts, lambda t: log1p_mean(predictor(t)))
    costs = own["words"] if token_count is word_count else F.transform(texts, token_count)
    split = rows.withColumn("_context", strip(F.col("prompt"))).withColumn(
        "_chunks", context_chunks(F.col("_context"), max_words)
    )
    return split.withColumns(
        {
            "_query_scores": similarity,
            "_trt_scores": reading,
            "_costs": costs,
            "original_context_tokens": token_count(F.col("_context")),
        }
    )


def build_contexts(
    rows: DataFrame, pairs: list[tuple[str, int | None]], max_words: int = 80, alpha: float = 1.0, beta: float = 0.25,
    tau_q: float = 0.05, tau_g: float = 0.1, token_count: Callable[[Column], Column] = word_count, **models,
) -> DataFrame:
    """Context of every (row, condition, budget) with its metadata.

    The pairs are a literal list of the run's settings, so they are exploded
    inside the row and nothing is joined or shuffled. A blank context has no
    chunks and is an error for a compressed condition.
    """
    scored = context_scores(rows, max_words, token_count=token_count, **models)
    literal = F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(b).cast("int").alias("budget")) for c, b in pairs])
    out = scored.select("*", F.explode(literal).alias("_pair")).withColumns(
        {"condition": F.col("_pair.condition"), "context_budget_tokens": F.col("_pair.budget")}
    )
    used = sorted({c for c, _ in pairs if c != FULL_CONTEXT})
    weights = F.lit(None).cast("array<double>")
    for name in used:
        weights = F.when(
            F.col("condition") == name,
            combine_scores(name, F.col("_query_scores"), F.col("_trt_scores"), alpha, beta, tau_q, tau_g),
        ).otherwise(weights)
    compressed = F.col("condition") != FULL_CONTEXT
    blank = F.raise_error(F.lit("cannot split an empty context")).cast(f"array<{SELECTED}>")
    out = out.withColumn("_weights", weights).withColumn(
        "_selected",
        F.when(
            compressed,
            F.when(F.size("_chunks") == 0, blank).otherwise(
                greedy_select(F.col("_chunks"), F.col("_weights"), F.col("_costs"), F.col("context_budget_tokens"))
            ),
        ),
    )
    out = out.withColumn(
        "compressed_context",
        F.when(compressed, F.array_join(F.transform("_selected", lambda s: s["text"]), "\n\n")).otherwise(F.col("_context")),
    ).withColumn(
        "compressed_context_tokens",
        F.when(compressed, token_count(F.col("compressed_context"))).otherwise(F.col("original_context_tokens")),
    )
    return out.withColumns(
        {
            "compression_ratio": F.when(
                compressed, compression_ratio(F.col("compressed_context_tokens"), F.col("original_context_tokens"))
            ).otherwise(F.lit(1.0)),
            "selected_chunk_count": F.when(compressed, F.size("_selected")),
            "selected_chunks": F.coalesce(
                F.transform(
                    "_selected",
                    lambda s: F.struct(
                        F.concat(F.lit("context:chunk="), s["index"].cast("string")).alias("chunk_id"),
                        s["index"].alias("index"), s["start"].alias("char_start"), s["end"].alias("char_end"),
                        s["score"].alias("score"), s["text"].alias("text"),
                    ),
                ),
                F.array().cast("array<struct<chunk_id:string,index:int,char_start:int,char_end:int,score:double,text:string>>"),
            ),
        }
    ).drop("_pair", "_context", "_chunks", "_query_scores", "_trt_scores", "_costs", "_weights", "_selected")


def score_pairs(contexts: DataFrame, scorer: Callable[..., Column], normalization: str = "mean",
                store_text: bool = False, together: bool = False) -> DataFrame:
    """Scores both responses of every context.

    ``scorer(prompt, response)`` gives the token log-probabilities of a
    response as array<double>; their mean or sum is the score (A18). With
    ``together`` it is ``scorer(prompt, responses)`` and gives those of both as
    array<array<double>>, so that both follow the same part of the prompt (M4).
    """
    if normalization not in ("sum", "mean"):
        raise ValueError(f"unsupported score normalization: {normalization}")
    prompt = reward_prompt(F.col("compressed_context"), F.col("question"))

    def score(log_probs: Column) -> Column:
        return let(
            log_probs,
            lambda lp: let(
                F.aggregate(lp, F.lit(0.0), lambda acc, x: acc + x),
                lambda s: s / F.greatest(F.lit(1), F.size(lp)) if normalization == "mean" else s,
            ),
        )

    identified = row_id(F.col("id"), F.col("row_index"))
    out = contexts.withColumn("row_id", identified)
    if together:
        out = out.withColumn("_both", scorer(prompt, F.array("chosen", "reject")))
        scores = {"chosen_score": score(F.col("_both")[0]), "reject_score": score(F.col("_both")[1])}
    else:
        scores = {"chosen_score": score(scorer(prompt, F.col("chosen"))), "reject_score": score(scorer(prompt, F.col("reject")))}
    out = out.withColumns(scores)
    texts = ["prompt", "question", "compressed_context", "chosen", "reject"] if store_text else []
    return out.select(
        prediction_id(F.col("row_id"), F.col("condition"), F.col("context_budget_tokens")).alias("id"),
        "row_id", "row_index", "condition", "context_budget_tokens",
        F.coalesce("subset", F.lit("")).alias("subset"), "chosen_model", "reject_model",
        "chosen_score", "reject_score",
        (F.col("chosen_score") - F.col("reject_score")).alias("score_delta"),
        (F.col("chosen_score") > F.col("reject_score")).alias("correct"),
        is_close(F.col("chosen_score"), F.col("reject_score")).alias("tie"),
        F.lit(normalization).alias("score_normalization"),
        "original_context_tokens", "compressed_context_tokens", "compression_ratio",
        "selected_chunk_count", "selected_chunks", *texts,
    )


def exact_median(df: DataFrame, keys: list[str], value: str, sketch: int = 1000) -> DataFrame:
    """Exact median per group without gathering a group.

    A mergeable quantile sketch brackets the middle of every group; only the
    distinct values inside the bracket (about 0.4 % of a large group) are
    ranked, on top of the count of rows below the bracket.
    """
    slack = 2.0 / sketch
    brackets = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx(value, [0.5 - slack, 0.5 + slack], F.lit(sketch)).alias("_b"),
    ).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", F.col("_b")[0].alias("_lo"), F.col("_b")[1].alias("_hi"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    placed = df.where(F.col(value).isNotNull()).join(brackets, on)
    counted = placed.where(F.col(value) <= F.col("_hi")).groupBy(
        *keys, "_n", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v")
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    cumulative = counted.agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(order))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def covers(r: Column) -> Column:
        return (F.col("_upto") >= r) & (F.col("_upto") - F.col("_c") < r)

    middle = (F.max(F.when(covers(low), F.col("_v"))) + F.max(F.when(covers(high), F.col("_v")))) / 2
    outside = F.raise_error(F.lit("the quantile bracket misses the median")).cast("double")
    return cumulative.groupBy(*keys).agg(F.coalesce(middle, outside).alias("median"))


def summarize(predictions: DataFrame) -> DataFrame:
    """Overall, per (condition, budget) and per (condition, budget, subset) in one relation.

    ``scope`` tells the grouping; a null budget is a value of its own.
    """
    def column(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in predictions.columns else default

    null_int = F.lit(None).cast("int")
    facts = predictions.select(
        column("condition", F.lit("")).alias("condition"),
        (F.col("context_budget_tokens") if "context_budget_tokens" in predictions.columns else null_int).alias(
            "context_budget_tokens"
        ),
        column("subset", F.lit("")).alias("subset"),
        F.col("correct").cast("double").alias("correct"),
        F.col("tie").cast("double").alias("tie"),
        F.col("score_delta").cast("double").alias("score_delta"),
        column("compression_ratio", F.lit(1.0)).cast("double").alias("compression_ratio"),
        column("compressed_context_tokens", F.lit(0.0)).cast("double").alias("compressed_context_tokens"),
    )
    none = F.lit(None).cast("string")
    scopes = F.array(
        F.struct(F.lit("overall").alias("scope"), none.alias("c"), null_int.alias("b"), none.alias("s")),
        F.struct(F.lit("condition").alias("scope"), F.col("condition").alias("c"), F.col("context_budget_tokens").alias("b"), none.alias("s")),
        F.struct(F.lit("subset").alias("scope"), F.col("condition").alias("c"), F.col("context_budget_tokens").alias("b"), F.col("subset").alias("s")),
    )
    expanded = facts.select(
        F.explode(scopes).alias("g"), "correct", "tie", "score_delta", "compression_ratio", "compressed_context_tokens"
    ).select(
        F.col("g.scope").alias("scope"), F.col("g.c").alias("condition"), F.col("g.b").alias("context_budget_tokens"),
        F.col("g.s").alias("subset"), "correct", "tie", "score_delta", "compression_ratio", "compressed_context_tokens",
    )
    keys = ["scope", "condition", "context_budget_tokens", "subset"]
    means = expanded.groupBy(*keys).agg(
        F.count("*").alias("count"), F.avg("correct").alias("accuracy"), F.avg("tie").alias("tie_rate"),
        F.avg("score_delta").alias("mean_score_delta"),
        F.avg("compression_ratio").alias("mean_compression_ratio"),
        F.avg("compressed_context_tokens").alias("mean_compressed_context_tokens"),
    )
    medians = exact_median(expanded, keys, "score_delta").select(
        *[F.col(k).alias(f"_m_{k}") for k in keys], F.col("median").alias("median_score_delta")
    )
    on = F.col("scope") == F.col("_m_scope")
    for k in keys[1:]:
        on = on & F.col(k).eqNullSafe(F.col(f"_m_{k}"))
    return means.join(medians, on, "left").select(
        *keys, "count", "accuracy", "tie_rate", "mean_score_delta", "median_score_delta",
        "mean_compression_ratio", "mean_compressed_context_tokens",
    )


def report_order(budget: str = "context_budget_tokens") -> list[Column]:
    """Group order of the written reports: by the text of the key, so 1024 comes before 512."""
    return [F.col("condition"), F.coalesce(F.col(budget).cast("string"), F.lit("null")), F.col("subset")]
