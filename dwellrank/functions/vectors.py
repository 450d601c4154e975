"""Vector expressions over array<double> and the deterministic hash encoder."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dwellrank.functions.arrays import let, total
from dwellrank.functions.text import words

HASH_BYTES = 32  # a SHA-256 digest; longer vectors repeat it


def as_double(v: Column) -> Column:
    """float32 storage, float64 arithmetic."""
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector when the norm is 0 or not finite (V1)."""
    return let(
        norm(v),
        lambda n: F.when((n > 0) & _finite(n), F.transform(v, lambda x: x / n)).otherwise(
            F.transform(v, lambda _: F.lit(0.0))
        ),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, 0 when either norm is 0 or not finite (V2)."""
    return let(
        norm(a) * norm(b),
        lambda n: F.when((n > 0) & _finite(n), dot(a, b) / n).otherwise(F.lit(0.0)),
    )


def scale_rows(rows: Column, weights: Column) -> Column:
    """diag(g)·H for an array of token vectors (V7)."""
    return F.zip_with(rows, weights, lambda row, g: F.transform(row, lambda x: x * g))


def add_vectors(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _digest_values(text: Column) -> Column:
    """The digest bytes of ``text`` scaled to [-1, 1]."""
    return let(
        F.sha2(text, 256),
        # four bytes per conversion of eight hex digits
        lambda h: F.flatten(
            F.transform(
                F.sequence(F.lit(1), F.lit(2 * HASH_BYTES - 7), F.lit(8)),
                lambda i: let(
                    F.conv(F.substr(h, i, F.lit(8)), 16, 10).cast("bigint"),
                    lambda x: F.array(
                        *[F.shiftright(x, k).bitwiseAND(255).cast("double") / 255.0 * 2.0 - 1.0 for k in (24, 16, 8, 0)]
                    ),
                ),
            )
        ),
    )


def hash_vector(text: Column, dim: int) -> Column:
    """Digest bytes repeated up to ``dim`` values, then normalised (V3)."""
    return let(
        _digest_values(text),
        lambda base: normalize(
            F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.get(base, i % HASH_BYTES))
        ),
    )


def hash_passage(token: Column, dim: int) -> Column:
    """Vector of one passage token (V4)."""
    return hash_vector(F.concat(F.lit("passage::"), F.lower(token)), dim)


def hash_pool(text: Column, dim: int, kind: str) -> Column:
    """Unit mean of the token vectors of a text, kind "query" (V5) or "passage" (V18).

    A vector longer than the digest repeats it, so for a multiple of 32 the
    sum is taken over one period and repeated once at the end.
    """
    period = HASH_BYTES if dim % HASH_BYTES == 0 else dim
    repeats = dim // period
    pooled = F.aggregate(
        words(text),
        zeros(period),
        lambda acc, w: add_vectors(acc, hash_vector(F.concat(F.lit(f"{kind}::"), F.lower(w)), period)),
        normalize,
    )
    if repeats == 1:
        return pooled
    return F.flatten(F.array_repeat(F.transform(pooled, lambda x: x / float(repeats) ** 0.5), repeats))


def hash_query(question: Column, dim: int) -> Column:
    return hash_pool(question, dim, "query")
