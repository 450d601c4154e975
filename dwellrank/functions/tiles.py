"""Words, pieces, windows and context pieces of texts as spans, found in Arrow batches.

A batch is taken in portions of some bytes of text, so a worker holds the batch
as it came and the spans of one portion. Words, pieces and windows come from
arrays over the characters of a portion; only the few pieces of a context are
made one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from dwellrank.functions.batches import list_rows

#: Bytes of text whose spans are made at a time.
PORTION_BYTES = 1 << 18

# what Python counts as whitespace: ASCII by table, the others by their UTF-8 bytes
_ASCII = np.zeros(256, bool)
_ASCII[[*range(9, 14), *range(28, 33)]] = True
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True

_PIECE = re.compile(r"[^\n.!?]+(?:[.!?]+|$)|[^\n.!?]+\n|(?s:.)")
_WORD = re.compile(r"\S+")


def portions(texts: pa.StringArray) -> Iterator[pa.StringArray]:
    """The rows in slices of about PORTION_BYTES, at least one row each."""
    places, at = _places(texts), 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(places, places[at] + PORTION_BYTES, "right")) - 1)
        yield texts.slice(at, stop - at)
        at = min(stop, len(texts))


def _places(texts: pa.StringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


class Characters:
    """The characters of some texts one after the other: their places among the bytes, which are no blanks, and where each text begins."""

    def __init__(self, texts: pa.StringArray):
        places, data = _places(texts), texts.buffers()[2]
        self.bytes = np.frombuffer(data if data is not None else b"", np.uint8)[places[0] : places[-1]]
        at = np.flatnonzero((self.bytes & 0xC0) != 0x80)
        lead = self.bytes[at]
        blank = _ASCII[lead]
        wide = np.flatnonzero(_LEADS[lead])
        if len(wide):
            blank[wide] = _wide_blanks(self.bytes, at[wide])
        self.solid, self.places = ~blank, np.r_[at, len(self.bytes)]
        self.firsts = np.searchsorted(at, places - places[0])
        self.valid = texts.is_valid().to_numpy(zero_copy_only=False)

    def words(self, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and past character of every word, or of its pieces of at most ``size`` characters."""
        before, after = np.r_[False, self.solid[:-1]], np.r_[self.solid[1:], False]
        inner = self.firsts[(self.firsts > 0) & (self.firsts < len(self.solid))]
        before[inner], after[inner - 1] = False, False
        begins, pasts = np.flatnonzero(self.solid & ~before), np.flatnonzero(self.solid & ~after) + 1
        if size is None:
            return begins, pasts
        times = -(-(pasts - begins) // size)
        nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        begins = np.repeat(begins, times) + size * nth
        return begins, np.minimum(begins + size, np.repeat(pasts, times))

    def by_text(self, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's spans, and the first character of every span's text."""
        bounds = np.searchsorted(begins, self.firsts)
        return bounds, np.repeat(self.firsts[:-1], np.diff(bounds))

    def solid_texts(self, begins: np.ndarray, pasts: np.ndarray) -> pa.StringArray:
        """The contents of spans that are all characters but blanks, in order."""
        data = self.bytes[np.repeat(self.solid, np.diff(self.places))]
        ends = np.r_[0, np.cumsum(self.places[pasts] - self.places[begins])].astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends), pa.py_buffer(data))

    def texts(self, begins: np.ndarray, pasts: np.ndarray) -> pa.Array:
        data = self.bytes.tobytes()
        return pa.array([data[a:b] for a, b in zip(self.places[begins].tolist(), self.places[pasts].tolist())], pa.binary()).cast(pa.string())

    def listed(self, items: pa.Array, bounds: np.ndarray) -> pa.ListArray:
        mask = None if self.valid.all() else pa.array(~self.valid)
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), items, mask=mask)


def _wide_blanks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the characters of several bytes that begin at ``at`` are U+0085, U+00A0, U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F or U+3000."""
    a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
    return ((a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
            | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80))


def spans(starts: np.ndarray, ends: np.ndarray, texts: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), texts], ["start", "end", "text"])


def word_column(texts: pa.StringArray, size: int | None = None) -> pa.ListArray:
    """Every word of each text, or its pieces, with its span; null for null."""
    c = Characters(texts)
    begins, pasts = c.words(size)
    bounds, base = c.by_text(begins)
    return c.listed(spans(begins - base, pasts - base, c.solid_texts(begins, pasts)), bounds)


def _windows(counts: np.ndarray, max_words: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word, counted over all texts, of every window of texts of so many words, and the number of each text's windows."""
    step = max_words - stride
    times = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - max_words) // step)), 0)
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    base = np.repeat(np.cumsum(counts) - counts, times)
    return base + nth * step, base + np.minimum(nth * step + max_words, np.repeat(counts, times)) - 1, times


def window_column(texts: pa.StringArray, max_words: int, stride: int) -> pa.ListArray:
    """Windows of ``max_words`` words with ``stride`` words of overlap; a null text has none."""
    c = Characters(texts)
    begins, pasts = c.words()
    bounds, _ = c.by_text(begins)
    first, last, times = _windows(np.diff(bounds), max_words, stride)
    base = np.repeat(c.firsts[:-1], times)
    found = spans(begins[first] - base, pasts[last] - base, c.texts(begins[first], pasts[last]))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(times)], pa.int32()), found)


def context_spans(text: str, max_words: int) -> list[tuple[int, int, str]]:
    """Pieces of a context that end in marks, and the end of its last line; long ones cut by words, a text without any as a whole."""
    out = []
    for m in _PIECE.finditer(text):
        tile = m[0]
        body = tile.strip()
        if not body or tile[0] in "\n.!?" or tile[-1] == "\n":
            continue
        start = m.start() + len(tile) - len(tile.lstrip())
        if len(body) < 2 * max_words or len(body.split(None, max_words)) <= max_words:
            out.append((start, start + len(body), body))
            continue
        words = [w.span() for w in _WORD.finditer(body)]
        for k in range(0, len(words), max_words):
            a, b = words[k][0], words[min(k + max_words, len(words)) - 1][1]
            out.append((start + a, start + b, body[a:b]))
    if not out and (body := text.strip()):
        start = len(text) - len(text.lstrip())
        out.append((start, start + len(body), body))
    return out


def context_column(texts: pa.StringArray, max_words: int) -> pa.ListArray:
    found = [[] if t is None else context_spans(t, max_words) for t in texts.to_pylist()]
    flat = [s for row in found for s in row]
    items = pa.StructArray.from_arrays(
        [pa.array([s[0] for s in flat], pa.int32()), pa.array([s[1] for s in flat], pa.int32()), pa.array([s[2] for s in flat], pa.string())], ["start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in found])], pa.int32()), items)


def overlaps(columns: tuple[pa.ListArray, ...]) -> Iterator[pa.ListArray]:
    """For every span of a text the indices of its tokens that overlap it, in portions of rows."""
    firsts, pasts, held = [], [], 0
    for a, b, starts, ends in zip(*map(list_rows, columns)):
        if any(x is None for x in (a, b, starts, ends)):
            firsts.append(None)
            pasts.append(None)
            continue
        firsts.append(np.searchsorted(ends, a, "right"))
        pasts.append(np.maximum(np.searchsorted(starts, b, "left"), firsts[-1]))
        held += int((pasts[-1] - firsts[-1]).sum())
        if held > PORTION_BYTES:
            yield _ranges(firsts, pasts)
            firsts, pasts, held = [], [], 0
    if firsts:
        yield _ranges(firsts, pasts)


def overlap_rows(rows: list[tuple[np.ndarray, ...]]) -> pa.ListArray:
    """The same of rows (span starts, span ends, token starts, token ends) that are one portion."""
    firsts = [np.searchsorted(ends, a, "right") for a, _, _, ends in rows]
    return _ranges(firsts, [np.maximum(np.searchsorted(starts, b, "left"), first) for (_, b, starts, _), first in zip(rows, firsts)])


def _ranges(firsts: list, pasts: list) -> pa.ListArray:
    none = np.zeros(0, np.int64)
    first, past = (np.concatenate([none if r is None else r for r in x]) for x in (firsts, pasts))
    width = past - first
    items = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(width)], pa.int32()), pa.array(items, pa.int32()))
    missing = [r is None for r in firsts]
    sizes = np.r_[0, np.cumsum([0 if r is None else len(r) for r in firsts])]
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner, mask=pa.array(missing) if any(missing) else None)


def moved_offsets(offsets: np.ndarray, prefix_len: int, text_len: int) -> np.ndarray:
    """``adjust_offsets`` of one text's (start, end) rows."""
    start, end = np.maximum(offsets[:, 0] - prefix_len, 0), np.minimum(offsets[:, 1] - prefix_len, text_len)
    outside = (offsets[:, 0] == offsets[:, 1]) | (offsets[:, 1] <= prefix_len) | (start >= end)
    return np.where(outside[:, None], -1, np.stack([start, end], axis=1))
