"""Periodic runs of words by longest common extensions on suffix trees.

A run is a maximal stretch of words with a period q. Every run with at least two periods has a Lyndon word of length q as its
root, and at the root's first word this is the longest Lyndon word that starts there, in one of the two orders of the alphabet. So each word offers two
candidates (the next smaller and the next greater suffix bound them), and each candidate is extended as far as its period goes: to
the right by the longest common extension of two suffixes, to the left by that of the reversed words. Ukkonen's algorithm builds the suffix trees of the
words and of their reversal; the Euler tour of a tree with a sparse table of minima answers each extension in constant time, many at once.

Trees are built where a run can be: of a run of at least ``least`` words and three periods, every word lies in a sequence of ``2 * least / 3`` words that
occurs again in the same run. Stretches without such repeats hold no run, whatever else they hold.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import exact_hashes, flat, mixed, steps, word_spans

#: Words and periods a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def suffix_tree(s: list[int], letters: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Ukkonen's suffix tree of ``s``, whose last value occurs nowhere else; values are below ``letters``.

    Returns where the label of the edge into each node begins and ends, and the children by node * letters + first value of the label.
    Leaves end at len(s); they are made in the order of their suffixes.
    """
    n = len(s)
    first, last, link = [0], [0], [0]
    child: dict[int, int] = {}
    node = place = length = open_ = 0
    for i, c in enumerate(s):
        open_ += 1
        made = 0  # the inner node that still needs its suffix link
        while open_:
            if not length:
                place = i
            key = node * letters + s[place]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(n)
                link.append(0)
                if made:
                    link[made] = node
                    made = 0
            else:
                start = first[below]
                span = min(last[below], i + 1) - start
                if length >= span:
                    node, place, length = below, place + span, length - span
                    continue
                if s[start + length] == c:
                    length += 1
                    if made:
                        link[made] = node
                    break
                inner = len(first)
                first += (start, i)
                last += (start + length, n)
                link += (0, 0)
                child[key] = inner
                child[inner * letters + c] = inner + 1
                first[below] = start + length
                child[inner * letters + s[start + length]] = below
                if made:
                    link[made] = inner
                made = inner
            open_ -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                place = i - open_ + 1
    return first, last, child


class Extensions:
    """Longest common extensions of the suffixes of ``s`` (values from 1): the Euler tour of the suffix tree and a sparse table over it.

    Two leaves meet at the shallowest visit between them. Of the visits between neighbouring leaves only the shallowest can matter, so the tour is kept as
    one depth for each two neighbouring leaves.
    """

    def __init__(self, s: list[int], letters: int):
        self.n = n = len(s)
        first, last, child = suffix_tree([*s, 0], letters)
        keys = sorted(child)
        below = [child[k] for k in keys]
        nodes = np.array(keys, np.int64) // letters
        begins = np.searchsorted(nodes, np.arange(len(first) + 1)).tolist()
        depth = [0] * len(first)
        place, meeting = [], []  # leaves in the order of the tour, and where each meets the one before it
        lowest = 0
        stack = [(0, -1)]
        while stack:
            node, turn = stack.pop()
            if turn >= 0:
                lowest = turn
            a, b = begins[node], begins[node + 1]
            here = depth[node]
            if a == b:
                place.append(n + 1 - here)
                meeting.append(lowest)
                continue
            for k in range(b - 1, a, -1):
                u = below[k]
                depth[u] = here + last[u] - first[u]
                stack.append((u, here))
            u = below[a]
            depth[u] = here + last[u] - first[u]
            stack.append((u, -1))
        self.rank = np.empty(n + 1, np.int64)
        self.rank[place] = np.arange(n + 1)
        self.table = [np.array(meeting, np.int32)]
        while 2 << (len(self.table) - 1) <= n:
            row, reach = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(row[:-reach], row[reach:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of the suffixes at i and at j (different ones, up to n)."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            out[at] = np.minimum(self.table[k][a[at]], self.table[k][b[at] - (1 << k) + 1])
        return out


def next_smaller(values: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value; len(values) if there is none."""
    out = np.full(len(values), len(values), np.int64)
    waiting: list[int] = []
    for j, v in enumerate(values):
        while waiting and values[waiting[-1]] > v:
            out[waiting.pop()] = j
        waiting.append(j)
    return out


def runs(words: list, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``words`` with at least ``least`` words and ``periods`` periods (two or more), by start, then period."""
    n = len(words)
    if n < max(least, periods):
        return np.zeros((0, 3), np.int64)
    names: dict = {}
    s = [names.setdefault(w, len(names) + 1) for w in words]
    ahead = Extensions(s, len(names) + 1)
    back = Extensions(s[::-1], len(names) + 1)
    found = []
    order = ahead.rank.tolist()  # with the empty suffix, which is the smallest
    for ranks in (order, [-r for r in order]):
        end = next_smaller(ranks)[:n]
        i = np.flatnonzero((end <= n) & ((end - np.arange(n)) * periods <= n))
        q = end[i] - i
        right = ahead.common(i, i + q)
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.common(n - i[inner], n - i[inner] - q[inner])
        length = left + q + right
        ok = length >= np.maximum(least, periods * q)
        found.append(np.stack([i - left, length, q], 1)[ok])
    found = np.unique(np.concatenate(found), axis=0)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def stretches(h: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Maximal stretches of words, each within one text, that are covered by sequences of 2 * least / 3 words that recur in their stretch.

    ``h``: hashes of all words; ``bounds``: where texts begin and end. Rounded down to a power of two, so that hashes of sequences come from doubling.
    """
    width = 1 << ((2 * least // 3).bit_length() - 1)
    if len(h) < width:
        return []
    seq, reach = h, 1
    while reach < width:
        seq = mixed(seq[:-reach] * np.uint64(0x9E3779B97F4A7C15) + seq[reach:] + np.uint64(reach))
        reach *= 2
    pieces = [(a, b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b - a >= least]
    while True:
        owner = np.full(len(h), -1, np.int64)
        stops = np.zeros(len(h), np.int64)
        for k, (a, b) in enumerate(pieces):
            owner[a:b], stops[a:b] = k, b
        at = np.flatnonzero((owner[: len(seq)] >= 0) & (np.arange(len(seq)) + width <= stops[: len(seq)]))
        key = seq[at] ^ mixed(owner[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = at[again]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + width, -1)
        inside = np.cumsum(cover[:-1]) > 0
        marked = np.where(inside, owner, -1)
        edge = np.flatnonzero(np.diff(np.r_[-1, marked, -1]))
        after = [(a, b) for a, b in zip(edge.tolist(), edge[1:].tolist()) if marked[a] >= 0 and b - a >= least]
        if after == pieces:
            return pieces
        pieces = after


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the part that is made periodic: for a tenth of all ids, by their crc32; None for the others, without words, and without an id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


COLUMNS = [
    ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))), ("collapsed", pa.binary()),
]


def _found(batches, least, periods, tails, full):
    for batch in batches:
        names = batch.column(0).to_pylist()
        data, offsets = flat(batch.column(1))
        for a, b in steps(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, bounds = word_spans(part, cuts)
            word = np.arange(len(starts))
            if tails:
                for k in range(a, b):
                    i, j = int(bounds[k - a]), int(bounds[k - a + 1])
                    if (tail := repeated_tail(names[k], j - i)) is not None:
                        word[i + tail[0] : j] = i + tail[0] + np.arange(j - i - tail[0]) % tail[1]
            h = exact_hashes(part, starts, ends)[word] if len(word) else np.zeros(0, np.uint64)
            raw = part.tobytes()
            found: dict[int, list] = {}
            dropped = np.zeros(len(word) + 1, np.int64)
            for i, j in stretches(h, bounds, least):
                text = int(np.searchsorted(bounds, i, "right")) - 1
                at = word[i:j]
                rows = runs([raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist())], least, periods)
                rows[:, 0] += i
                np.add.at(dropped, rows[:, 0] + rows[:, 2], 1)
                np.add.at(dropped, rows[:, 0] + rows[:, 1], -1)
                rows[:, 0] -= bounds[text]
                found.setdefault(text, []).extend(rows.tolist())
            kept = np.cumsum(dropped[:-1]) == 0
            src = word[kept]
            size = ends[src] - starts[src] + 1
            to = np.r_[0, np.cumsum(size)]
            out = part[np.minimum(np.arange(to[-1]) + np.repeat(starts[src] - to[:-1], size), max(0, len(part) - 1))] if len(src) else np.zeros(0, np.uint8)
            out[to[1:] - 1] = 0x20
            collapsed = out.tobytes()
            edges = to[np.r_[0, np.cumsum(kept)][bounds]].tolist()
            columns: dict[str, list] = {n: [] for n, _ in COLUMNS}
            for k in range(b - a):
                rows = sorted(found.get(k, ()), key=lambda r: (r[0], r[2]))
                best = max(rows, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
                text = collapsed[edges[k] : max(edges[k], edges[k + 1] - 1)]
                values = (
                    names[a + k], len(rows), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
                    hashlib.sha256("".join(f"{x},{y},{q}\n" for x, y, q in rows).encode()).hexdigest(), hashlib.sha256(text).hexdigest(), rows if full else None, text if full else None,
                )
                for c, v in zip(columns.values(), values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in COLUMNS[: None if full else -2]], [n for n, _ in COLUMNS[: None if full else -2]])


def periodic_runs(
    docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS, tails: bool = False, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest length / period (of equal
    ones the first, then the one with the smallest period; null without a run); runs_sha256, of a line ``start,length,period`` for every run by start, then period; and
    collapsed_sha256, of the words that stay when of each run only its first period is kept, joined by one blank. ``with_text`` adds runs and collapsed themselves.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text and equal when their bytes are; they are numbered from 0. A null text has none. With ``tails`` a tenth of the texts, by
    crc32 of the id, are made periodic from some word on, as a known amount of repetition; rows without an id are left as they are. An empty table gives an
    empty result, rows that repeat an id are rows of their own, further columns are not read. No shuffle; a task holds the trees of one stretch at a time.
    """
    shape = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(lambda it: _found(it, least, periods, tails, with_text), shape + ", runs array<array<bigint>>, collapsed binary" * with_text)
    return found.withColumn("collapsed", F.col("collapsed").cast("string")) if with_text else found
