"""Text expressions with Python's notion of whitespace and exact character offsets.

Words, windows and context pieces are found in Arrow batches (``tiles``). Other
offsets come from a regular expression that covers the text without gaps, so
the running total of its matches' lengths gives the end of every match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from dwellrank.functions import tiles
from dwellrank.functions.arrays import let, running_totals
from dwellrank.functions.batches import give_back

# Python's notion of whitespace in Java's terms: the Unicode white-space property plus
# U+001C..U+001F. The property test needs the U flag, so every pattern that uses a
# class below begins with it; a class that spells out the characters is ten times slower.
U = "(?U)"
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"[^\s\x1c-\x1f]"
WORD = f"{NON_SPACE}+"

SPAN = "struct<start:int,end:int,text:string>"


# the same characters one by one, for what trims without a pattern
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{U}{SPACE}+", " ")


def normalize_text(c: Column) -> Column:
    """Whitespace runs to one blank, stripped, lower case."""
    return F.lower(strip(collapse(c)))


def normalize_level(c: Column, data_type: str = "string") -> Column:
    """Difficulty level 0/1/2 or a name to adv/int/ele; other text stays."""
    if data_type == "boolean":
        return F.coalesce(c.cast("int").cast("string"), F.lit(""))
    text = F.lower(strip(c.cast("string")))
    number = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("decimal(38,0)"))
    return (
        F.when(c.isNull(), F.lit(""))
        .when(number == 0, F.lit("adv"))
        .when(number == 1, F.lit("int"))
        .when(number == 2, F.lit("ele"))
        .when(text.startswith("adv"), F.lit("adv"))
        .when(text.startswith("int"), F.lit("int"))
        .when(text.startswith("ele"), F.lit("ele"))
        .otherwise(text)
    )


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(U + WORD), F.lit(0))


def word_count(c: Column) -> Column:
    """Whitespace token count (T17, the model-free token counter)."""
    return F.size(words(c))


def _in_portions(c: Column, found: Callable[[pa.StringArray], pa.ListArray]) -> Column:
    @F.arrow_udf(f"array<{SPAN}>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in tiles.portions(batch):
                yield found(part)
            give_back()

    return spans(c)


def word_spans(c: Column) -> Column:
    """Every whitespace-delimited word with its character span."""
    return _in_portions(c, lambda texts: tiles.word_column(texts))


def piece_spans(c: Column, size: int) -> Column:
    """Words cut into pieces of at most ``size`` characters, as a sub-word tokenizer yields."""
    return _in_portions(c, lambda texts: tiles.word_column(texts, size))


def sentence_spans(c: Column) -> Column:
    """Sentences that end at .!? plus closing quotes before a blank or the end (T4).

    The first sentence starts at 0 even when the text begins with blanks.
    """
    pattern = rf"(?sU).*?[.!?]+[\"')\]]*(?={SPACE}|\z)|.+\z"
    tiles = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    spans = let(
        tiles,
        lambda ts: let(
            running_totals(F.transform(ts, F.length)),
            lambda ends: F.transform(
                ts,
                lambda t, i: let(
                    F.when(i == 0, t).otherwise(lstrip(t)),
                    lambda body: F.struct(
                        (F.get(ends, i) - F.length(body)).alias("start"),
                        F.get(ends, i).alias("end"),
                        body.alias("text"),
                    ),
                ),
            ),
        ),
    )
    return F.filter(spans, lambda s: s["text"].rlike(U + NON_SPACE))


def word_windows(c: Column, max_words: int, stride: int = 0) -> Column:
    """Windows of ``max_words`` words with ``stride`` words of overlap (T5)."""
    _check_windows(max_words, stride)
    return _in_portions(c, lambda texts: tiles.window_column(texts, max_words, stride))


def _check_windows(max_words: int, stride: int) -> None:
    if max_words <= 0:
        raise ValueError("max_words must be positive")
    if stride < 0 or stride >= max_words:
        raise ValueError("stride must lie between 0 and max_words - 1")


def _windows_within(c: Column, max_words: int, stride: int) -> Column:
    """``word_windows`` as an expression, for the items of an array."""
    _check_windows(max_words, stride)
    step = max_words - stride

    def cut(ts: Column, ends: Column) -> Column:
        n = F.size(ts)
        first = F.filter(
            F.sequence(F.lit(0), n - 1, F.lit(step)),
            lambda i: (i == 0) | (i - F.lit(step) + F.lit(max_words) < n),
        )
        return F.transform(
            first,
            lambda i: let(
                lstrip(F.array_join(F.slice(ts, i + 1, F.lit(max_words)), "")),
                lambda body: let(
                    F.get(ends, F.least(i + F.lit(max_words), n) - 1),
                    lambda end: F.struct(
                        (end - F.length(body)).alias("start"), end.alias("end"), body.alias("text")
                    ),
                ),
            ),
        )

    return let(
        F.regexp_extract_all(c, F.lit(f"{U}{SPACE}*{WORD}"), F.lit(0)),
        lambda ts: F.when(
            F.size(ts) > 0,
            let(running_totals(F.transform(ts, F.length)), lambda ends: cut(ts, ends)),
        ).otherwise(F.array().cast(f"array<{SPAN}>")),
    )


def _shift(spans: Column, by: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["text"].alias("text")),
    )


def _split_long(spans: Column, max_words: int, stride: int) -> Column:
    """Replace every span of more than ``max_words`` words by its word windows."""
    return F.flatten(
        F.transform(
            spans,
            lambda s: F.when(word_count(s["text"]) <= max_words, F.array(s)).otherwise(
                _shift(_windows_within(s["text"], max_words, stride), s["start"])
            ),
        )
    )


def paragraph_chunks(text: Column, strategy: str, max_words: int, stride: int = 0) -> Column:
    """Chunk spans of a paragraph by sentence, word window or as a whole."""
    if strategy == "whole_paragraph":
        spans = let(
            strip(text),
            lambda body: F.when(
                F.length(body) > 0,
                let(
                    F.length(text) - F.length(lstrip(text)),
                    lambda start: F.array(
                        F.struct(
                            start.alias("start"), (start + F.length(body)).alias("end"), body.alias("text")
                        )
                    ),
                ),
            ).otherwise(F.array().cast(f"array<{SPAN}>")),
        )
    elif strategy == "fixed_words":
        return word_windows(text, max_words, stride)
    elif strategy == "sentence":
        spans = _split_long(sentence_spans(text), max_words, stride)
    else:
        raise ValueError(f"unknown chunking strategy: {strategy}")
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), strip(s["text"]).alias("text"))
    )


def context_chunks(text: Column, max_words: int = 80) -> Column:
    """Punctuation-delimited pieces of a context, long ones cut by words.

    A line without closing punctuation that a newline follows is dropped, as in
    the original behaviour. A text without any piece becomes one chunk; a blank
    text gives an empty array.
    """
    if max_words <= 0:
        raise ValueError("max_words must be positive")
    return _in_portions(text, lambda texts: tiles.context_column(texts, max_words))


def span_words_to_chars(spans: Column, indices: Column) -> Column:
    """Flat inclusive word-index pairs to character spans."""
    return let(spans, lambda words: _word_pairs(words, indices))


def _word_pairs(spans: Column, indices: Column) -> Column:
    n = F.size(spans)

    def pair(k: Column) -> Column:
        first, last = F.get(indices, k), F.get(indices, k + 1)
        valid = (first >= 0) & (last < n) & (first <= last)
        return F.when(
            valid,
            F.struct(
                F.get(spans, first)["start"].alias("start"),
                F.get(spans, last)["end"].alias("end"),
            ),
        ).otherwise(F.raise_error(F.lit("invalid word span")).cast("struct<start:int,end:int>"))

    return (
        F.when(F.size(indices) == 0, F.array().cast("array<struct<start:int,end:int>>"))
        .when(
            F.size(indices) % 2 != 0,
            F.raise_error(F.lit("span index list must contain start/end pairs")).cast(
                "array<struct<start:int,end:int>>"
            ),
        )
        .otherwise(F.transform(F.sequence(F.lit(0), F.size(indices) - 2, F.lit(2)), pair))
    )


# ASCII punctuation, and typographic quotes and dashes with their ASCII forms.
ASCII_PUNCT = r"!-/:-@\[-`{-~"
TYPOGRAPHIC = "“”‘’–—"
TYPOGRAPHIC_ASCII = "\"\"''--"


def canonical_word(c: Column) -> Column:
    """Lower-case word without surrounding punctuation, quotes and dashes unified."""
    plain = strip(F.translate(c, TYPOGRAPHIC, TYPOGRAPHIC_ASCII))
    return F.lower(F.regexp_replace(plain, rf"\A[{ASCII_PUNCT}]+|[{ASCII_PUNCT}]+\z", ""))


def adjust_offsets(offsets: Column, prefix_len: Column | int, text_len: Column) -> Column:
    """Move tokenizer offsets from the prefixed text to the text; (-1,-1) when outside."""
    prefix = F.lit(prefix_len) if isinstance(prefix_len, int) else prefix_len

    def move(o: Column, limit: Column) -> Column:
        start = F.greatest(F.lit(0), o["start"] - prefix)
        end = F.least(limit, o["end"] - prefix)
        outside = (o["start"] == o["end"]) | (o["end"] <= prefix) | (start >= end)
        return F.struct(
            F.when(outside, F.lit(-1)).otherwise(start).alias("start"),
            F.when(outside, F.lit(-1)).otherwise(end).alias("end"),
        )

    # counting the characters of a text takes a pass over it: once, not per token
    return let(text_len, lambda limit: F.transform(offsets, lambda o: move(o, limit)))


def overlapping_tokens(spans: Column, starts: Column, ends: Column) -> Column:
    """For every span of one text the indices of the tokens that overlap it.

    ``starts``/``ends`` are the ascending offsets of non-overlapping tokens, so
    each span is two searches among them.
    """
    @F.arrow_udf("array<array<int>>")
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from tiles.overlaps(batch)

    return found(spans["start"], spans["end"], starts, ends)
