"""The length heuristic for predicted reading times, and token mass in one row."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from dwellrank.functions.arrays import let
from dwellrank.functions.batches import list_column, list_rows
from dwellrank.functions.text import words

# The names of the predicted word features.
FEATURE_NAMES = ("nFix", "FFD", "GPT", "TRT", "fixProp")


def heuristic_trt(word: Column) -> Column:
    """A tenth of the word's length without surrounding non-alphanumerics."""
    core = F.regexp_replace(word, r"\A[^A-Za-z0-9]+|[^A-Za-z0-9]+\z", "")
    return F.length(core) / F.lit(10.0)


_CORE = re.compile(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", re.S)


def heuristic_scores(texts: Column) -> Column:
    """struct<score: array<double>, words: array<int>>: of every chunk the mean of log1p of its words' predicted reading times (A17), and its words.

    The same numbers as ``log1p_mean`` over ``heuristic_trt`` of ``words``; 0 for a blank chunk.
    """

    @F.arrow_udf("struct<score:array<double>,words:array<int>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                known: dict[str, float] = {}
                rows = [None if r is None else [_reading_time(t, known) for t in r] for r in list_rows(batch.slice(a, 256))]
                columns = [[None if r is None else np.array([x[k] for x in r], np.float64) for r in rows] for k in (0, 1)]
                yield pa.StructArray.from_arrays([list_column(columns[0]), list_column(columns[1], pa.int32())], ["score", "words"])

    return scored(texts)


def word_times(words: list[str]) -> np.ndarray:
    """``heuristic_trt`` of every word."""
    known: dict[str, float] = {}
    return np.fromiter((known[w] if w in known else known.setdefault(w, _time(w)) for w in words), np.float64, len(words))


def _time(word: str) -> float:
    core = _CORE.search(word)
    return len(core[0]) / 10.0 if core else 0.0


def _reading_time(text: str, known: dict[str, float]) -> tuple[float, int]:
    words, total = text.split(), 0.0
    for w in words:
        time = known.get(w)
        if time is None:
            time = known[w] = math.log1p(_time(w))
        total += time
    return (total / len(words) if words else 0.0), len(words)


def heuristic_words(text: Column) -> Column:
    """Words of a text with predicted reading time and features."""
    return F.transform(
        words(text),
        lambda w: let(
            heuristic_trt(w),
            lambda t: F.struct(
                w.alias("word"),
                t.alias("trt"),
                F.struct(
                    (t + 1.0).alias("nFix"),
                    t.alias("FFD"),
                    t.alias("GPT"),
                    t.alias("TRT"),
                    F.least(F.lit(1.0), t).alias("fixProp"),
                ).alias("features"),
            ),
        ),
    )
