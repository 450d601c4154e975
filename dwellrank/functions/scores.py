"""Score expressions: softmax, gaze distribution, combiner, overlap, ties."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from dwellrank.functions.arrays import let, total

QUERY_ONLY = "query_only_compression"
TRT_ONLY = "predicted_et_only_compression"
QUERY_X_TRT = "query_x_predicted_et_compression"
FULL_CONTEXT = "full_context"
COMPRESSION_CONDITIONS = (QUERY_ONLY, TRT_ONLY, QUERY_X_TRT)


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def finite_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), x).otherwise(F.lit(0.0))


def uniform(values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(1.0) / F.size(values))


def softmax(values: Column, temperature: float) -> Column:
    """Softmax with temperature; non-finite inputs weigh 0, all non-finite gives uniform."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    peak = F.array_max(F.filter(values, is_finite)) / temperature

    def weights(top: Column) -> Column:
        return F.transform(
            values, lambda x: F.when(is_finite(x), F.exp(x / temperature - top)).otherwise(F.lit(0.0))
        )

    return let(
        peak,
        lambda top: F.when(
            top.isNotNull(),
            let(weights(top), lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s))),
        ).otherwise(uniform(values)),
    )


def gaze_weight(trt: Column, transform: str = "log1p", eps: float = 1e-8) -> Column:
    """Unnormalised gaze weight of one token."""
    if eps <= 0:
        raise ValueError("eps must be positive")
    value = F.greatest(finite_or_zero(trt), F.lit(0.0))
    if transform == "log1p":
        return F.log1p(value) + eps
    if transform in ("identity", "none"):
        return value + eps
    raise ValueError(f"unknown gaze transform: {transform}")


def gaze_distribution(token_trt: Column, transform: str = "log1p", eps: float = 1e-8) -> Column:
    """Token reading times to weights that sum to 1 (V6)."""
    return let(
        F.transform(token_trt, lambda x: gaze_weight(x, transform, eps)),
        lambda w: let(total(w), lambda s: F.transform(w, lambda x: x / s)),
    )


def gaze_concentration(values: Column, top_percent: float) -> Column:
    """Sum of the largest ceil(p·n) values, at least one."""
    if not 0 < top_percent <= 1:
        raise ValueError("top_percent must satisfy 0 < top_percent <= 1")
    ordered = F.reverse(F.array_sort(F.transform(values, finite_or_zero)))
    keep = F.greatest(F.lit(1), F.ceil(F.size(values) * F.lit(float(top_percent))).cast("int"))
    return total(F.slice(ordered, F.lit(1), keep))


def combine_scores(
    condition: str,
    query_scores: Column | None = None,
    trt_scores: Column | None = None,
    alpha: float = 1.0,
    beta: float = 0.25,
    tau_q: float = 0.05,
    tau_g: float = 0.1,
    eps: float = 1e-12,
) -> Column:
    """Chunk distribution from query scores, reading-time scores or their product."""
    if condition not in COMPRESSION_CONDITIONS:
        raise ValueError(f"unknown compression condition: {condition}")
    if condition != TRT_ONLY and query_scores is None:
        raise ValueError("query scores are required")
    if condition != QUERY_ONLY and trt_scores is None:
        raise ValueError("reading-time scores are required")
    if condition == QUERY_ONLY:
        return softmax(query_scores, tau_q)
    if condition == TRT_ONLY:
        return softmax(trt_scores, tau_g)
    product = F.zip_with(
        softmax(query_scores, tau_q),
        softmax(trt_scores, tau_g),
        lambda p, g: F.pow(p + eps, F.lit(float(alpha))) * F.pow(g + eps, F.lit(float(beta))),
    )
    return let(
        product,
        lambda c: let(
            total(c),
            lambda s: F.when(is_finite(s) & (s > 0), F.transform(c, lambda x: x / s)).otherwise(uniform(c)),
        ),
    )


def log1p_mean(values: Column) -> Column:
    """mean(log1p(max(0, x))), 0 for an empty array."""
    return F.when(
        F.size(values) > 0,
        total(F.transform(values, lambda x: F.log1p(F.greatest(F.lit(0.0), x)))) / F.size(values),
    ).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two id sets; two empty sets overlap fully (A5)."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(
        F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
    )


def is_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Tie test (V19)."""
    return F.coalesce((a == b) | (F.abs(a - b) <= atol + rtol * F.abs(b)), F.lit(False))


def compression_ratio(compressed: Column, original: Column) -> Column:
    """Compressed over original tokens, 1 when there was nothing to compress."""
    return F.when(original <= 0, F.lit(1.0)).otherwise(compressed / original)


def first_argmax(scores: Column) -> Column:
    """Index of the largest score, the first one on a tie."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def nan() -> Column:
    return F.lit(math.nan)
