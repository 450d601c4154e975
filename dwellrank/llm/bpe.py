"""Byte-level BPE by speculation and verification.

Greedy longest match proposes tokens for each word. A sequence of tokens is what the merges give if and only if every two
neighbours are compatible, that is no merge ever joins across their border. All pairs of all new words are tested at once
with arrays; only the words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.common import worker_cache

#: Words whose tokens a task keeps; beyond that it starts anew, and looks once more among those kept before.
KEPT_WORDS = 120_000
NEVER = 1 << 30


def byte_of_character() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special strings of a tokenizer file; tokens as bytes, merges as ranks from 1 (single bytes have 0)."""

    def __init__(self, content: bytes):
        parsed = json.loads(content)
        letters = byte_of_character()
        spelled = {t: bytes(letters[c] for c in t) for t in parsed["model"]["vocab"]}
        self.ids = {spelled[t]: i for t, i in parsed["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.tokens = [b""] * size
        for token, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.tokens[i] = token
        self.rank, self.left, self.right = np.zeros(size, np.int64), np.full(size, -1), np.full(size, -1)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(parsed["model"]["merges"], 1):
            x, y = (spelled[t] for t in (merge if isinstance(merge, list) else merge.split(" ")))
            i = self.ids[x + y]
            self.merges[self.ids[x], self.ids[y]] = (r, i)
            if not self.rank[i]:
                self.rank[i], self.left[i], self.right[i] = r, self.ids[x], self.ids[y]
        keys = np.array([x * size + y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.size, self.longest = size, max(map(len, self.ids))
        self.whole = {t: np.uint32(i).tobytes() for t, i in self.ids.items() if self._is_its_own_merge(i)}
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.offsets = np.r_[0, np.cumsum(self.lengths)]
        special = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({special})") if special else None

    def _is_its_own_merge(self, i: int) -> bool:
        return self.rank[i] > 0 or len(self.tokens[i]) == 1

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of neighbouring tokens whether no merge joins across their border.

        Going back in time, the token at the border on either side is undone into its part at the border. Where both stand,
        from the later one's making until the first one is used up, a merge of the two would have happened. Of equal
        merges the left one comes first: on the left side the use wins against the join, on the right side the join does.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        used_x, used_y = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(open_):
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)
            joined = (rank < used_x) & (rank <= used_y) & (rank < NEVER)
            good[open_[joined]] = False
            later_x = self.rank[x] >= self.rank[y]
            undo = np.where(later_x, self.rank[x], self.rank[y])
            go = ~joined & (undo > 0)
            open_, x, y, used_x, used_y, later_x, undo = (v[go] for v in (open_, x, y, used_x, used_y, later_x, undo))
            used_x, used_y = np.where(later_x, undo, used_x), np.where(later_x, used_y, undo)
            x, y = np.where(later_x, self.right[x], x), np.where(later_x, y, self.left[y])
        return good

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, out, i, n = self.ids, [], 0, len(word)
        while i < n:
            j = min(n, i + self.longest)
            while (token := ids.get(word[i:j])) is None:
                j -= 1
            out.append(token)
            i = j
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, from left to right."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(parts) > 200:
            return self._merged_long(parts)
        get = self.merges.get
        found = [get(p, (NEVER, 0)) for p in zip(parts, parts[1:])]
        while found and (best := min(found))[0] < NEVER:
            i = found.index(best)  # the leftmost of the lowest rank
            parts[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = get((parts[i - 1], parts[i]), (NEVER, 0))
            if i < len(found):
                found[i] = get((parts[i], parts[i + 1]), (NEVER, 0))
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a queue and links, for words of any length."""
        import heapq

        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        queue = [(m[0], i, p) for i, p in enumerate(zip(parts, parts[1:])) if (m := self.merges.get(p))]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = self.merges[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := self.merges.get(p := (parts[k], parts[after[k]]))):
                    heapq.heappush(queue, (m[0], k, p))
        return [p for p in parts if p >= 0]

    def encoded_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian token ids of each word; returns them in the order of ``words``."""
        whole, ids = self.whole, self.ids
        proposals = [[ids[w]] if w in whole else self.proposed(w) for w in words]
        sizes = np.array([len(p) for p in proposals], np.int64)
        tokens = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        keys = tokens[inner] * self.size + tokens[inner + 1]
        pairs, back = np.unique(keys, return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed = set(word[inner[~good[back]]].tolist())
        raw, ends = tokens.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for k in failed:
            out[k] = np.array(self.merged(words[k]), "<u4").tobytes()
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes one after the other."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids) or not ends[-1]:
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - n), n)].tobytes()


def vocabulary(content: bytes) -> Vocabulary:
    """Compiled once in each worker."""
    key = ("bpe", hashlib.sha256(content).hexdigest())
    cache = worker_cache()
    if key not in cache:
        cache[key] = Vocabulary(content)
    return cache[key]


class Encoder:
    """Encodes whole texts; remembers the tokens of words."""

    def __init__(self, table: Vocabulary, pattern: str):
        self.table, self.split = table, regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Words by the pattern; special strings are pieces of their own."""
        if self.table.specials is None:
            return self.split.findall(text)
        parts = self.table.specials.split(text)
        if len(parts) == 1:
            return self.split.findall(text)
        return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else self.split.findall(part))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian token ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        for s, i in self.table.special.items():
            known.setdefault(s, np.uint32(i).tobytes())
        split = [self.pieces(t) for t in texts]
        new = {w for words in split for w in words if w not in known}
        again = new & before.keys()
        known.update((w, before[w]) for w in again)
        new = list(new - again)
        known.update(zip(new, self.table.encoded_words([w.encode() for w in new])))
        return [b"".join(map(known.__getitem__, words)) for words in split]


def _portions(texts: list[str | None], most: int = 1 << 19):
    rows, size = [], 0
    for t in texts:
        rows.append(t or "")
        size += len(rows[-1])
        if size >= most:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, and with ``with_ids`` the token ids and the decoded text.

    ``path``: a byte-level BPE tokenizer file; ``pattern``: its word pattern. Special strings in a text become their tokens, as
    they do by default in the library of that format. Null is empty; an empty text has no token. Further columns are not read.
    """
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data

    def run(batches):
        table = vocabulary(content.value)
        encoder = Encoder(table, pattern)  # its words go with the task, so that later stages have the memory
        for batch in batches:
            names, row = batch.column(0).to_pylist(), 0
            for texts in _portions(batch.column(1).to_pylist()):
                out = {"doc_id": names[row : row + len(texts)], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
                row += len(texts)
                for raw in encoder.encode(texts):
                    ids = np.frombuffer(raw, "<u4")
                    text = table.decoded(ids)
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
                        out["decoded"].append(text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in columns], [c for c, _ in columns])

    columns = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    if with_ids:
        columns += [("ids", pa.list_(pa.int32())), ("decoded", pa.string())]
    shape = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, shape)
