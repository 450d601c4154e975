"""Reading times of words to weights of tokens."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from dwellrank.functions.arrays import let, total
from dwellrank.functions.batches import PORTION, give_back, list_column, list_rows, struct_column
from dwellrank.functions.text import TYPOGRAPHIC, TYPOGRAPHIC_ASCII

_TO_ASCII = str.maketrans(TYPOGRAPHIC, TYPOGRAPHIC_ASCII)
SPANS = "array<struct<start:int,end:int>>"


def bare_word(word: str) -> str:
    """The word as placement compares it: plain quotes, no outer punctuation, lower case."""
    return word.translate(_TO_ASCII).strip().strip(string.punctuation).lower()


def _place(word: str, token: str, start: int, cursor: int, bare: dict[str, str]) -> tuple[int, int] | None:
    """Span of ``word`` in the text token that begins at ``start``, or None."""
    if token == word:
        return start, start + len(token)
    inner = word.strip(string.punctuation)
    for form in (word, inner):
        at = token.find(form) if form else -1
        if at >= 0 and start + at >= cursor:
            return start + at, start + at + len(form)
    for text in (token, word):
        if text not in bare:
            bare[text] = bare_word(text)
    if bare[token] != bare[word]:
        return None
    at = token.find(word)
    return (start + at, start + at + len(word)) if at >= 0 else (start, start + len(token))


def place_words(starts, tokens, words, compat: bool = True) -> list[tuple[int, int]]:
    """Spans of ``words`` found in order among the text's tokens.

    With ``compat`` the token just used is tried again, so a doubled word maps
    to its first occurrence twice; without it the next occurrence is taken.
    """
    spans, cursor, at, bare = [], 0, 0, {}
    for n, word in enumerate(words):
        wanted = str(word).strip()
        if not wanted:
            raise ValueError(f"empty word at position {n}")
        for k in range(at, len(tokens)):
            used_up = not compat and starts[k] + len(tokens[k]) <= cursor
            found = None if used_up else _place(wanted, tokens[k], starts[k], cursor, bare)
            if found and (compat or found[0] >= cursor):
                spans.append(found)
                at, cursor = k, found[1]
                break
        else:
            raise ValueError(f"cannot align word {n} {wanted!r} after character {cursor}")
    return spans


def align_words_udf(compat: bool = True, strict: bool = True):
    """Arrow function (token starts, tokens, words) -> spans; the cursor makes it sequential."""

    @F.arrow_udf(SPANS)
    def align(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        column = lambda out: struct_column(out, ("start", "end"), pa.int32())
        for starts, tokens, words in batches:
            out, held = [], 0
            for at, *row in zip(*map(list_rows, (starts, tokens, words))):
                try:
                    out.append(np.array(place_words(at.tolist(), *row, compat=compat), np.int64).reshape(-1, 2))
                    held += len(out[-1])
                except ValueError:
                    if strict:
                        raise
                    out.append(None)
                if held > PORTION:
                    yield column(out)
                    out, held = [], 0
            if out:
                yield column(out)

    return align


def reader_runs(aligned: DataFrame) -> DataFrame:
    """Word records of one (example, reader) as ordered arrays.

    Repeated readings of a word are summed first, so a row grows with the words
    of the text and not with the number of readings. Records are dealt out once,
    by example and reader, and both steps work on what a task has then.
    A null or NaN skip counts as not skipped.
    """
    used = aligned.select("example_id", "reader_id", "word_index", "word", "src_ordinal", "trt", "skip")
    runs = used.repartition("example_id", "reader_id").groupBy("example_id", "reader_id", "word_index", "word").agg(
        F.min("src_ordinal").alias("src_ordinal"),
        F.sum(F.when(F.isnan("trt"), 0.0).otherwise(F.col("trt"))).alias("trt"),
        F.count("*").alias("n"),
        F.count_if(F.coalesce(F.nanvl("skip", F.lit(0.0)), F.lit(0.0)) < 0.5).alias("inspected"),
    )
    ordered = runs.groupBy("example_id", "reader_id").agg(
        F.array_sort(F.collect_list(F.struct("word_index", "src_ordinal", "word", "trt", "n", "inspected"))).alias("r")
    )
    return ordered.select(
        "example_id", "reader_id",
        *[F.col(f"r.{field}").alias(field) for field in ("word", "trt", "n", "inspected")],
    )


#: Tokens of a text whose sums are one row on their way.
RUN = 1 << 12
RUNS = "example_id string, part int, length int, n long, gaze array<double>"


def mean_gaze(vectors: DataFrame) -> DataFrame:
    """Mean gaze vector per example from one weight array per reader.

    Arrays travel in runs of tokens, summed over the readers that a task meets
    before and after they are dealt out by text, so neither an example with
    very many readers nor a long text is collected. Unequal lengths are an error.
    """
    size = F.size("weights")
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((size - 1) / RUN).cast("int")))
    runs = vectors.where(F.col("weights").isNotNull()).select("example_id", F.explode(parts).alias("part"), size.alias("length"), "weights")
    runs = runs.select("example_id", "part", "length", F.lit(1).cast("long").alias("n"), F.slice("weights", F.col("part") * RUN + 1, F.lit(RUN)).alias("gaze"))
    dealt = runs.mapInArrow(_summed_in_portions, RUNS).repartition("example_id").sortWithinPartitions("example_id", "part")
    means = dealt.mapInArrow(_summed_in_order, RUNS)
    arrays = means.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "gaze"))).alias("_v"))
    mean = F.flatten(F.transform("_v", lambda x: F.transform(x["gaze"], lambda g: g / x["n"])))
    return arrays.select("example_id", let(mean, lambda v: let(total(v), lambda s: F.transform(v, lambda x: x / s))).alias("weights"))


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, int, np.ndarray]]:
    for batch in batches:
        example, part, length, n = (batch.column(k).to_pylist() for k in range(4))
        yield from zip(zip(example, part), length, n, list_rows(batch.column(4)))
        give_back()


def _with_run(sums: dict[tuple, list], key: tuple, length: int, n: int, gaze: np.ndarray) -> int:
    """Adds to the sums; the items that are held anew."""
    held = sums.get(key)
    if held is None:
        sums[key] = [length, n, np.array(gaze, np.float64)]
        return len(gaze)
    if held[0] != length:
        raise ValueError("gaze vectors of one example differ in length")
    held[1] += n
    held[2] += gaze
    return 0


def _run_batch(sums: dict[tuple, list]) -> pa.RecordBatch:
    length, n, gaze = zip(*sums.values())
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array(length, pa.int32()), pa.array(n, pa.int64()), list_column(list(gaze))],
        ["example_id", "part", "length", "n", "gaze"])


def _summed_in_portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, held = {}, 0
    for row in _run_rows(batches):
        held += _with_run(sums, *row)
        if held > PORTION:
            yield _run_batch(sums)
            sums, held = {}, 0
    if sums:
        yield _run_batch(sums)


def _summed_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by example and run; lengths are held against the example's first."""
    sums, held, last, of = {}, 0, None, None
    for key, length, n, gaze in _run_rows(batches):
        if last is not None and key[0] == last[0]:
            if length != of:
                raise ValueError("gaze vectors of one example differ in length")
        else:
            of = length
        if key != last and held > PORTION:
            yield _run_batch(sums)
            sums, held = {}, 0
        last = key
        held += _with_run(sums, key, length, n, gaze)
    if sums:
        yield _run_batch(sums)


def deranged_rotation(readers: DataFrame, seed: int) -> DataFrame:
    """Every reader gets the next reader's data in a seeded digest order (V15, SQL form).

    The next reader is looked up inside one of 256 digest buckets; only the
    last reader of a bucket takes the first one of a later bucket, so an
    example with any number of readers is never ordered in one task.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), "example_id", "reader_id"), 256)
    keyed = readers.select("example_id", "reader_id").distinct().withColumn("_h", digest).withColumn(
        "_bucket", F.conv(F.substr("_h", F.lit(1), F.lit(2)), 16, 10).cast("int")
    )
    inside = Window.partitionBy("example_id", "_bucket").orderBy("_h")
    linked = keyed.withColumn("_next", F.lead("reader_id").over(inside))
    heads = keyed.groupBy("example_id", "_bucket").agg(F.min_by("reader_id", "_h").alias("_head"))
    circle = Window.partitionBy("example_id").orderBy("_bucket")
    whole = Window.partitionBy("example_id").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    heads = heads.select(
        "example_id", "_bucket",
        F.coalesce(F.lead("_head").over(circle), F.first("_head").over(whole)).alias("_later"),
    )
    return linked.join(heads, ["example_id", "_bucket"]).select(
        "example_id", "reader_id", F.coalesce("_next", "_later").alias("source_reader")
    )


def deranged_shuffle(readers: DataFrame, seed: int, ordinal: str = "example_ordinal") -> DataFrame:
    """The seeded shuffle with the published generator, repeated until no reader keeps their own data.

    Seeded with ``seed`` + the example's ordinal. The generator orders the
    reader ids of one example as a whole; only the ids travel, never word rows.
    """
    per_example = (
        readers.select("example_id", ordinal, "reader_id").distinct()
        .groupBy("example_id", ordinal).agg(F.array_sort(F.collect_list("reader_id")).alias("ids"))
    )

    @F.pandas_udf("array<string>")
    def sources(ids: pd.Series, start: pd.Series) -> pd.Series:
        return pd.Series([derange(list(names), seed + int(k)) for names, k in zip(ids, start)])

    mapped = per_example.withColumn("sources", sources("ids", ordinal))
    return mapped.select("example_id", F.explode(F.arrays_zip("ids", "sources")).alias("p")).select(
        "example_id", F.col("p.ids").alias("reader_id"), F.col("p.sources").alias("source_reader")
    )


def derange(ids: list[str], seed: int, tries: int = 1000) -> list[str]:
    """A shuffle of ``ids`` without a fixed point; one id stays."""
    if len(ids) == 1:
        return ids
    generator, drawn = np.random.default_rng(seed), list(ids)
    for _ in range(tries):
        generator.shuffle(drawn)
        if not any(a == b for a, b in zip(ids, drawn)):
            return drawn
    return ids[1:] + ids[:1]
