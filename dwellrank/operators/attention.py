"""Gaze-weighted attention over the tokens of a text, pooled to chunk vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from dwellrank.functions.batches import PORTION, give_back, list_column, list_rows, matrix_column
from dwellrank.functions.reading import word_times
from dwellrank.operators.tokens import bare_word, place_words

BLOCK_CELLS = 1 << 18  # attention scores held at a time
KEY_BLOCK = 1 << 12  # distinct tokens that are keys at a time
OUT_CELLS = PORTION  # items of chunk vectors that are held before they are passed on
FLAT = 1e-3  # scores up to which the softmax is made from a series
SCORED_WORDS = 1 << 14  # words whose vectors are held at a time
HASHED_ROWS = 1 << 10  # vectors that are made of digests at a time


def unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    ok = (n > 0) & np.isfinite(n)
    return np.where(ok, m / np.where(ok, n, 1.0), 0.0)


def hash_rows(tokens: list[str], dim: int, prefix: str = "passage::") -> np.ndarray:
    """Hash-encoder vectors of distinct lower-case tokens (V4)."""
    digests = [hashlib.sha256((prefix + t).encode("utf-8")).digest() for t in tokens]
    raw = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(len(tokens), 32)
    columns, rows = np.arange(dim) % 32, np.empty((dim, len(tokens))).T
    parts = -(-len(tokens) // HASHED_ROWS)
    for k in range(parts):
        part = slice(k * len(tokens) // parts, (k + 1) * len(tokens) // parts)
        rows[part] = unit_rows(raw[part, columns] / 255.0 * 2.0 - 1.0)
    return rows


def attention_state(queries: np.ndarray, values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Softmax of every query row over some keys as a state that can be merged.

    Per query: the greatest score, the sum of the exponentials relative to it
    and the sum of the values weighted by them; a key counts ``counts`` times.
    """
    scores = queries @ values.T
    peak = scores.max(axis=1)
    scores -= peak[:, None]
    np.exp(scores, out=scores)
    scores *= counts
    return peak, scores.sum(axis=1), scores @ values


def merge_states(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state over the keys of both."""
    peak = np.maximum(a[0], b[0])
    left, right = np.exp(a[0] - peak), np.exp(b[0] - peak)
    return peak, a[1] * left + b[1] * right, a[2] * left[:, None] + b[2] * right[:, None]


def _keys(rows: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens that occur, and how often."""
    counts = np.bincount(inverse, minlength=len(rows)).astype(np.float64)
    used = np.flatnonzero(counts)
    return used, counts[used]


def attention_states(
    rows: np.ndarray, inverse: np.ndarray, weights: np.ndarray, mask: np.ndarray | None = None, begin: int = 0, past: int | None = None,
) -> Iterator[tuple[slice, tuple | None]]:
    """States of diag(g)·H·Hᵀ/√d for H = rows[inverse], for blocks of the tokens [begin, past) over all tokens (V8).

    Equal token vectors are one key with a multiplicity: the work is
    tokens × distinct tokens. Keys are taken in blocks whose states are merged,
    so the memory is one block of scores, whatever the text. Masked tokens are
    no keys; without any key the state is None.
    """
    used, counts = _keys(rows, inverse if mask is None else inverse[mask])
    values = rows[used]
    scale = np.sqrt(rows.shape[1])
    past = len(inverse) if past is None else past
    block = max(16, BLOCK_CELLS // max(1, min(KEY_BLOCK, len(used))))
    for at in range(begin, past, block):
        part = slice(at, min(past, at + block))
        queries = weights[part, None] / scale * rows[inverse[part]]
        states = (attention_state(queries, values[k:k + KEY_BLOCK], counts[k:k + KEY_BLOCK]) for k in range(0, len(used), KEY_BLOCK))
        yield part, reduce(merge_states, states) if len(used) else None


def _series(rows: np.ndarray, used: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each distinct token the sums over all keys of (value, 1) times the 0th, 1st and 2nd power of their inner product, over 0!, 1! and 2!."""
    values, dim = rows[used], rows.shape[1]
    both = np.c_[values, np.ones(len(values))] * counts[:, None]
    zeroth = np.broadcast_to(both.sum(axis=0), (len(rows), dim + 1))
    first = rows @ (values.T @ both)
    if dim * (dim + 1) // 2 < len(values):  # the squares of inner products are inner products of the vectors' products
        i, j = np.triu_indices(dim)
        twice = np.where(i == j, 1.0, 2.0)
        sums = np.zeros((len(i), dim + 1))
        for k in range(0, len(values), 512):
            part = values[k:k + 512]
            sums += (part[:, i] * part[:, j] * twice).T @ both[k:k + 512]
        second = np.concatenate([(rows[k:k + 512][:, i] * rows[k:k + 512][:, j]) @ sums for k in range(0, len(rows), 512)])
    else:
        second = (rows @ values.T) ** 2 @ both
    return [zeroth, first, second / 2]


def attend(
    rows: np.ndarray, inverse: np.ndarray, weights: np.ndarray, mask: np.ndarray | None = None, begin: int = 0, past: int | None = None,
) -> Iterator[np.ndarray]:
    """softmax(diag(g)·H·Hᵀ/√d)·H, block by block (V8). Masked tokens attend to nothing.

    The weights of a long text are so small that exp(x) = 1 + x + x²/2 to
    within FLAT³/6 of it, less than the vectors' single precision shows: the
    sums over the keys are then made once for each distinct token instead of
    for each token.
    """
    past = len(inverse) if past is None else past
    if mask is None and past - begin > len(rows) and np.abs(weights[begin:past]).max() * (rows * rows).sum(axis=1).max() <= FLAT * np.sqrt(rows.shape[1]):
        terms = _series(rows, *_keys(rows, inverse))
        for at in range(begin, past, 4096):
            part = slice(at, min(past, at + 4096))
            a = weights[part, None] / np.sqrt(rows.shape[1])
            sums = terms[0][inverse[part]] + a * (terms[1][inverse[part]] + a * terms[2][inverse[part]])
            yield sums[:, :-1] / sums[:, -1:]
        return
    for part, state in attention_states(rows, inverse, weights, mask, begin, past):
        out = np.zeros((part.stop - part.start, rows.shape[1])) if state is None else state[2] / state[1][:, None]
        if mask is not None:
            out[~mask[part]] = 0.0
        yield out


def pool_chunks(blocks: Iterator[np.ndarray], firsts: np.ndarray, pasts: np.ndarray, dim: int) -> np.ndarray:
    """Unit mean of the token rows [first, past) of every chunk, from a stream of blocks.

    Chunks may overlap; a chunk without tokens is an error.
    """
    if (pasts <= firsts).any():
        raise ValueError("a chunk covers no token")
    sums = np.zeros((len(firsts), dim))
    at = 0
    for block in blocks:
        upto = np.vstack([np.zeros((1, dim)), np.cumsum(block, axis=0)])
        a = np.clip(firsts - at, 0, len(block))
        b = np.clip(pasts - at, 0, len(block))
        sums += upto[b] - upto[a]
        at += len(block)
    return unit_rows(sums / (pasts - firsts)[:, None])


def _token_range(starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b, side="left")


def _distinct(tokens) -> tuple[list[str], np.ndarray]:
    ids: dict[str, int] = {}
    inverse = np.fromiter((ids.setdefault(t.lower(), len(ids)) for t in tokens), dtype=np.int64, count=len(tokens))
    return list(ids), inverse


def encoder_rows(dim: int) -> Callable:
    """The hash encoder as a function tokens -> (distinct rows, index of each token's row)."""

    def encode(tokens) -> tuple[np.ndarray, np.ndarray]:
        names, inverse = _distinct(tokens)
        return hash_rows(names, dim), inverse

    return encode


def hash_chunk_scores(question: Column, texts: Column, dim: int) -> Column:
    """Cosine of a question with every chunk text under the hash encoder.

    The same numbers as ``hash_pool`` as an expression, about ten times faster
    on long texts: each word of a portion of texts is hashed once.
    """

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for questions, chunks in batches:
            yield from portioned_cosines(questions, chunks, dim)

    return score(question, texts)


def portioned_cosines(questions: pa.Array, chunks: pa.ListArray, dim: int) -> Iterator[pa.Array]:
    """The scores of a batch in portions of rows, each of about SCORED_WORDS words with the questions'."""
    known, pooled, asked, held = {}, [], [], 0
    for question, row in zip(questions, list_rows(chunks)):
        asked.append(_word_ids(question.as_py(), "query", known))
        pooled.append([_word_ids(t, "passage", known) for t in row])
        held += len(asked[-1]) + sum(map(len, pooled[-1]))
        if held > SCORED_WORDS:
            yield _cosines(known, pooled, asked, dim)
            known, pooled, asked, held = {}, [], [], 0
    if pooled:
        yield _cosines(known, pooled, asked, dim)


def _cosines(known: dict[str, int], pooled: list[list[np.ndarray]], asked: list[np.ndarray], dim: int) -> pa.Array:
    rows = hash_rows(list(known), dim, "")
    return list_column([_mean_cosines(rows, ids, q) for ids, q in zip(pooled, asked)])


def _mean_cosines(rows: np.ndarray, chunks: list[np.ndarray], question: np.ndarray) -> np.ndarray:
    """Cosine of the question's mean row with every chunk's mean row; 0 for a blank chunk."""
    lengths = np.array([len(c) for c in chunks])
    sums = np.zeros((len(chunks), rows.shape[1]))
    some, upto = np.flatnonzero(lengths), np.cumsum(lengths[lengths > 0])
    at = 0
    while at < len(some):  # whole chunks of some thousand words at a time
        before = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + SCORED_WORDS, "right")))
        part = some[at:stop]
        begins = np.concatenate([[0], upto[at:stop - 1] - before])
        sums[part] = np.add.reduceat(rows[np.concatenate([chunks[k] for k in part])], begins, axis=0)
        at = stop
    return unit_rows(sums) @ unit_rows(rows[question].sum(axis=0, keepdims=True))[0]


def _word_ids(text: str, kind: str, known: dict[str, int]) -> np.ndarray:
    words = text.split()
    return np.fromiter((known.setdefault(f"{kind}::{w.lower()}", len(known)) for w in words), np.int64, len(words))


def chunk_vectors(tokens: Column, token_starts: Column, weights: Column, chunk_starts: Column, chunk_ends: Column,
                  dim: int, encode: Callable | None = None, hidden: Column | None = None) -> Column:
    """array<array<float>>: one vector per chunk of one text under one weighting.

    Null weights give the plain text view (V10). One row is one (text,
    weighting), so the readers of one text are independent rows. ``hidden``
    holds the bytes of a plugged-in model's float32 vector of every token (M1);
    without it tokens are encoded here.
    """
    rows_of = encode or encoder_rows(dim)
    own = hidden is not None

    @F.arrow_udf("array<array<float>>")
    def vectors(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        last, cached = None, None
        for batch in batches:
            out, held = [], 0
            given = iter(batch[5]) if own else None
            for words, starts, weight, a, b in zip(*map(list_rows, batch[:5])):
                if given is not None:
                    flat = np.frombuffer(next(given).as_buffer(), np.float32).reshape(len(words), -1)
                    cached = flat.astype(np.float64), np.arange(len(words))
                elif words != last:
                    last, cached = words, rows_of(words)
                rows, inverse = cached
                ends = starts + np.fromiter(map(len, words), np.int64, len(words))
                firsts, pasts = _token_range(starts, ends, a, b)
                begin, past = int(firsts.min(initial=len(inverse))), int(pasts.max(initial=0))
                if weight is None:
                    blocks = (rows[inverse[i:min(past, i + 4096)]] for i in range(begin, past, 4096))
                else:
                    if weight.shape != inverse.shape:
                        raise ValueError("one weight per token is needed")
                    blocks = attend(rows, inverse, weight, begin=begin, past=past)
                out.append(pool_chunks(blocks, firsts - begin, pasts - begin, rows.shape[1]).astype(np.float32))
                held += out[-1].size
                if held > OUT_CELLS:
                    yield matrix_column(out)
                    out, held = [], 0
            if out:
                yield matrix_column(out)

    return vectors(tokens, token_starts, weights, chunk_starts, chunk_ends, *([] if hidden is None else [hidden]))


def softmax_states(tokens: Column, weights: Column, dim: int, encode: Callable | None = None) -> Column:
    """struct<peak, total: array<double>> of every token's softmax over all tokens of its text.

    The probability of key j for query i is exp(score(i, j) - peak[i]) / total[i].
    """
    rows_of = encode or encoder_rows(dim)

    @F.arrow_udf("struct<peak:array<double>,total:array<double>>")
    def states(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        column = lambda peaks, totals: pa.StructArray.from_arrays([list_column(peaks), list_column(totals)], ["peak", "total"])
        for words, weight in batches:
            peaks, totals, held = [], [], 0
            for w, g in zip(list_rows(words), list_rows(weight)):
                found = [state for _, state in attention_states(*rows_of(w), g)]
                peaks.append(np.concatenate([f[0] for f in found]))
                totals.append(np.concatenate([f[1] for f in found]))
                held += len(w)
                if held > PORTION:
                    yield column(peaks, totals)
                    peaks, totals, held = [], [], 0
            if peaks:
                yield column(peaks, totals)

    return states(tokens, weights)


def reader_weights(tokens: Column, token_starts: Column, word: Column, trt: Column, n: Column, inspected: Column,
                   transform: str = "log1p", eps: float = 1e-8, compat: bool = True) -> Column:
    """Per-token gaze distribution, inspection weight and reading-time mass of one reader.

    ``n`` readings of a word were summed to one entry. If a later reading of a
    word could only be placed elsewhere in the text the sum cannot be split, so
    that is an error: exclude repeated readings then.
    """

    @F.arrow_udf("struct<gaze:array<double>,inspect:array<double>,mass:array<double>>")
    def weigh(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        column = lambda loads: pa.StructArray.from_arrays(
            [list_column([distribution(m, transform, eps) for m, _ in loads]), list_column([i for _, i in loads]), list_column([m for m, _ in loads])], ["gaze", "inspect", "mass"])
        for token, start, word_, trt_, n_, inspected_ in batches:
            loads, held = [], 0
            rows = zip(_TextRows(token), list_rows(start), _TextRows(word_), list_rows(trt_), list_rows(n_), list_rows(inspected_))
            for t, s, w, *numbers in rows:
                loads.append(_loads(t, s, w, *numbers, compat))
                held += len(loads[-1][0])
                if held > PORTION:
                    yield column(loads)
                    loads, held = [], 0
            if loads:
                yield column(loads)
            del loads
            give_back()

    return weigh(tokens, token_starts, word, trt, n, inspected)


def predicted_weights(tokens: Column, token_starts: Column, transform: str = "log1p", eps: float = 1e-8, compat: bool = True) -> Column:
    """Per-token gaze distribution of a text whose tokens are its words, read as long as their lengths predict."""

    @F.arrow_udf("array<double>")
    def weigh(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for token, start in batches:
            found, held = [], 0
            for t, s in zip(_TextRows(token), list_rows(start)):
                ones = np.ones(len(t.sizes))
                mass, _ = _loads(t, s, t, word_times(t.strings()), ones, ones, compat)
                found.append(distribution(mass, transform, eps))
                held += len(found[-1])
                if held > PORTION:
                    yield list_column(found)
                    found, held = [], 0
            if found:
                yield list_column(found)

    return weigh(tokens, token_starts)


def _text_words(tokens, starts) -> tuple[list[str], list[int]]:
    """Words of the text and their starts: tokens that follow each other without a gap are parts of one word."""
    if len(tokens) and not any(t[:1].isspace() or t[-1:].isspace() for t in tokens):
        at = np.asarray(starts)
        ends = at + np.fromiter(map(len, tokens), np.int64, len(tokens))
        first = np.flatnonzero(np.r_[True, at[1:] != ends[:-1]]).tolist()
        return ["".join(tokens[a:b]) for a, b in zip(first, [*first[1:], len(tokens)])], at[first].tolist()
    words, begins, end = [], [], -1
    for token, start in zip(tokens, starts):
        inner = token.lstrip()
        if start == end and inner == token and words:
            words[-1] += token.rstrip()
        else:
            words.append(inner.rstrip())
            begins.append(int(start) + len(token) - len(inner))
        end = start + len(token) if token == token.rstrip() else -1
    return words, begins


def _in_place(texts: list[str], words: list[str], compat: bool) -> bool:
    """Whether every word is placed on the text's word of the same number: the words are the text's, and with ``compat`` no word is alike to the next."""
    if texts != words or not all(texts):
        return False
    if not compat:
        return True
    bare = {t: bare_word(t) for t in set(texts)}
    return all(bare[a] != bare[b] for a, b in zip(texts, texts[1:]))


class _Texts:
    """One row of a column of string lists: the strings' lengths, their joined bytes, and the strings when asked for."""

    def __init__(self, items: pa.Array, sizes: np.ndarray, joined: memoryview):
        self.items, self.sizes, self.joined = items, sizes, joined

    def strings(self) -> list[str]:
        return self.items.to_pylist()


class _TextRows:
    """The rows of a column of string lists as ``_Texts``; lengths are counted for the whole batch at once."""

    def __init__(self, column: pa.ListArray):
        self.ends, self.items = column.offsets.to_numpy(), column.values
        self.sizes = pc.utf8_length(self.items).to_numpy(zero_copy_only=False)
        _, places, data = self.items.buffers()
        self.places = np.frombuffer(places, np.int32)[self.items.offset:] if places else np.zeros(1, np.int32)
        self.data = memoryview(data if data is not None else b"")

    def __iter__(self) -> Iterator[_Texts]:
        for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist()):
            yield _Texts(self.items.slice(a, b - a), self.sizes[a:b], self.data[self.places[a]:self.places[b]])


def _same_words(tokens: _Texts, starts: np.ndarray, words: _Texts) -> tuple[np.ndarray, np.ndarray] | None:
    """Starts and lengths of the text's words if ``words`` are just these, none with a blank in it; else None."""
    sizes = tokens.sizes
    if not len(sizes) or tokens.items.null_count or words.items.null_count or (words.sizes == 0).any() or tokens.joined != words.joined:
        return None
    text = bytes(tokens.joined).decode()
    if len(text.split(None, 1)) != 1 or text[:1].isspace() or text[-1:].isspace():
        return None
    first = np.flatnonzero(np.r_[True, starts[1:] != (starts + sizes)[:-1]])
    found = np.add.reduceat(sizes, first)
    return (starts[first], found) if np.array_equal(found, words.sizes) else None


def _loads(tokens: _Texts, starts: np.ndarray, words: _Texts, trt, n, inspected, compat: bool) -> tuple[np.ndarray, np.ndarray]:
    """``token_loads`` of one row; words that are the text's own need no strings."""
    placed = None if compat else _same_words(tokens, starts, words)
    if placed is None:
        return token_loads(tokens.strings(), starts, words.strings(), trt, n, inspected, compat)
    begins, sizes = placed
    return _spread(starts, starts + tokens.sizes, begins, begins + sizes, trt, n, inspected)


def token_loads(tokens, token_starts, word, trt, n, inspected, compat=True):
    """Reading time that falls on every token, each word's split equally over its tokens (A12), and the share of its readings that were not skipped.

    Tokens may be parts of words, as a sub-word encoder gives them.
    """
    starts = np.asarray(token_starts)
    ends = starts + np.array([len(t) for t in tokens])
    texts, begins = _text_words(tokens, token_starts)
    word = list(word)
    if _in_place(texts, word, compat):
        at = np.asarray(begins)
        spans = np.stack([at, at + np.fromiter(map(len, texts), np.int64, len(texts))], 1)
    else:
        spans = np.array(place_words(begins, texts, word, compat)).reshape(-1, 2)
    for k in np.flatnonzero(np.asarray(n, dtype=np.float64) > 1):
        # a second reading stays put unless the word is only a part of its token
        at = np.searchsorted(begins, spans[k, 0], side="right") - 1
        part = str(word[k]).strip()
        if texts[at] != part and bare_word(texts[at]) != bare_word(part):
            raise ValueError(f"repeated reading of a part of a word: {word[k]!r}")
    return _spread(starts, ends, spans[:, 0], spans[:, 1], trt, n, inspected)


def _spread(starts, ends, begins, pasts, trt, n, inspected) -> tuple[np.ndarray, np.ndarray]:
    """What words at [begins, pasts) lay on the tokens at [starts, ends)."""
    n, trt = np.asarray(n, dtype=np.float64), np.asarray(trt, dtype=np.float64)
    firsts, pasts = _token_range(starts, ends, begins, pasts)
    width = pasts - firsts
    if (width <= 0).any():
        raise ValueError("a word overlaps no token")
    at = np.repeat(firsts - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
    mass = np.bincount(at, np.repeat(np.nan_to_num(trt) / width, width), len(starts))
    seen = np.bincount(at, np.repeat(n, width), len(starts))
    looked = np.bincount(at, np.repeat(np.asarray(inspected, dtype=np.float64), width), len(starts))
    return mass, np.divide(looked, seen, out=np.zeros(len(starts)), where=seen > 0)


def distribution(mass, transform="log1p", eps=1e-8):
    """Token weights that sum to 1 (V6, W4); what is not finite or negative counts as 0."""
    mass = np.maximum(np.nan_to_num(mass, nan=0.0, posinf=0.0, neginf=0.0), 0.0)
    gaze = (np.log1p(mass) if transform == "log1p" else mass) + eps
    return gaze / gaze.sum()
