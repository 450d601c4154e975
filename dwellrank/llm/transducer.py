"""Token counts by deterministic transducers.

Two machines read a text. The first one, over kinds of characters, cuts it into words: the text is cut into chunks of equal
length, each chunk is compiled into its state map (the state it leaves for every state it may be entered in), the maps are
composed by a parallel prefix scan, and then all chunks run at once from their known entry states. The second one, over
bytes, counts tokens: each transition is annotated with the change it makes to the number of tokens of what has been read. All
words of a portion run in step. The second machine's states are finite in number, but many; a transition is compiled when
it is first taken.
"""

from __future__ import annotations

import bisect
import hashlib
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellrank.llm.bpe import NEVER, Vocabulary, vocabulary
from dwellrank.llm.common import flat, steps, worker_cache

#: Characters of a chunk of the first machine.
CHUNK = 64
#: States after which the second machine is compiled anew; 84 MB of tables.
MOST_STATES = 1 << 16

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK_LAST, BLANK_INNER, SPACE_LAST, SPACE_INNER = range(9)
FREE, LETTERS, NUMBERS, OTHERS, SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)


def word_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if a word starts) by symbol and state; symbols from 9 on are the same at the start of a text.

    Words are contractions, letters, numbers or other characters with at most one blank before them, and white space, of
    which the last blank goes to what follows. SHORT and LONG are apostrophes that one or two letters make a contraction.
    """
    state = np.zeros((18, 8), np.uint8)
    start = np.ones((18, 8), np.uint8)
    for symbol, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        state[symbol] = own
        start[symbol, [own, PREFIX]] = 0
    state[LETTER, ONE_MORE], start[LETTER, ONE_MORE] = FREE, 0
    state[LETTER, TWO_MORE], start[LETTER, TWO_MORE] = ONE_MORE, 0
    for symbol, own in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):
        state[symbol] = own
        state[symbol, [OTHERS, PREFIX]] = OTHERS
        start[symbol, [OTHERS, PREFIX]] = 0
    state[BLANK_LAST] = PREFIX
    state[SPACE_LAST] = FREE
    for symbol in (BLANK_INNER, SPACE_INNER):
        state[symbol] = SPACES
        start[symbol, SPACES] = 0
    state[9:] = state[:9, :1]
    return state, start


def character_kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_INNER for every code point."""
    cache = worker_cache()
    if "kinds" not in cache:
        kinds = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            if (kind := unicodedata.category(chr(c))[0]) in "LN":
                kinds[c] = LETTER if kind == "L" else NUMBER
        # the characters with the property White_Space, fixed by the Unicode standard
        kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE_INNER
        cache["kinds"] = kinds
    return cache["kinds"]


def symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The first machine's input: the kind of each character, told apart further by what follows it in its text."""
    kind = character_kinds()[points]
    n = len(points)
    last = np.zeros(n, bool)
    last[firsts[1:] - 1] = True
    last[-1] = True
    space = kind == SPACE_INNER
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = ~space[1:]
    before_solid &= ~last
    out = kind.copy()
    blank = space & (points == 0x20)
    out[blank] = BLANK_INNER
    out[space & before_solid] = SPACE_LAST
    out[blank & before_solid] = BLANK_LAST
    mark = np.flatnonzero((points == 0x27) & ~last)
    if len(mark):
        one = points[mark + 1]
        near = np.minimum(mark + 2, n - 1)
        two = np.where(last[mark + 1] | (mark + 2 >= n), 0, points[near])
        out[mark[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[mark[pair]] = LONG
    out[firsts] += 9
    return out


def word_starts(symbol: np.ndarray) -> np.ndarray:
    """Where words start. Chunk maps, a prefix scan of their compositions, then one run of all chunks."""
    state, start = word_machine()
    n = len(symbol)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    nexts, starts = state.ravel(), start.ravel()
    for row in grid:
        maps = nexts[(row.astype(np.uint16) * 8)[:, None] + maps]
    reach = 1  # after each round a map covers twice as many chunks
    while reach < chunks:
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), 1)
        reach *= 2
    now = np.r_[np.uint8(FREE), maps[:-1, FREE]].astype(np.uint16)
    out = np.zeros((CHUNK, chunks), np.uint8)
    for k, row in enumerate(grid):
        at = row.astype(np.uint16) * 8 + now
        out[k] = starts[at]
        now = nexts[at].astype(np.uint16)
    return np.flatnonzero(np.ascontiguousarray(out.T).ravel()[:n])


class TokenMachine:
    """The second machine. What the bytes to come can still depend on is, for every place where a token may have begun that
    is not complete yet, the tokens that may not stand there, and how many tokens end there.

    A state is the longest end of what has been read that begins some token, with these two for each place in it; ends of
    equal states have equal futures. A transition emits the change of the number of tokens of what has been read.
    """

    def __init__(self, table: Vocabulary):
        self.table = table
        self.sorted = sorted(t for t, i in table.ids.items() if table.rank[i] or len(t) == 1)
        self.place = {t: k for k, t in enumerate(self.sorted)}
        self.prefixes = {t[:n] for t in self.sorted for n in range(len(t) + 1)}
        self.spans: dict[bytes, tuple[int, int]] = {b"": (0, len(self.sorted))}
        self._plant()
        self.barred: dict[int, array] = {-1: array("i")}
        self.clear()

    def clear(self):
        """Forgets all states but the first one."""
        self.signs: dict[tuple, int] = {}
        self.known_signs: dict[tuple[int, bytes], int] = {}
        self.infos: list[tuple[bytes, tuple, tuple]] = []
        self.states: dict[tuple, int] = {}
        self.next, self.emit = np.full((1024, 256), -1, np.int32), np.zeros((1024, 256), np.int8)
        self._state(b"", (-1,), (0,))

    def _plant(self):
        """Orders tokens so that those that begin by growing from one token, from some merge on, are neighbours."""
        table = self.table
        kids: dict[int, list[int]] = {}
        for i in sorted((table.ids[t] for t in self.sorted), key=lambda i: table.rank[i]):
            kids.setdefault(int(table.left[i]), []).append(i)  # -1 for single bytes
        self.begin, self.end, preorder = {}, {}, []
        stack = [(-1, False)]
        while stack:
            i, over = stack.pop()
            if over:
                self.end[i] = len(preorder)
                continue
            if i >= 0:
                self.begin[i] = len(preorder)
                preorder.append(self.place[table.tokens[i]])
            stack.append((i, True))
            stack += [(k, False) for k in reversed(kids.get(i, ()))]
        self.preorder = np.array(preorder, np.int32)
        self.kids = {i: (k, [int(table.rank[c]) for c in k]) for i, k in kids.items()}
        self.partners: dict[int, list[tuple[int, int]]] = {}
        for (x, y), (r, _) in table.merges.items():
            self.partners.setdefault(x, []).append((r, y))

    def _barred(self, token: int) -> array:
        """Places, in the order of bytes, of the tokens that cannot follow ``token``: some merge would join across the border."""
        if token not in self.barred:
            table, x, used, spans = self.table, token, NEVER, []
            while True:
                for r, y in self.partners.get(x, ()):
                    if r < used:
                        spans.append(self.preorder[self.begin[y] : self.begin[y] + 1])
                        kids, ranks = self.kids.get(y, ((), ()))
                        k = bisect.bisect_left(ranks, r)
                        if k < len(kids):
                            spans.append(self.preorder[self.begin[kids[k]] : self.end[y]])
                if not table.rank[x]:
                    break
                used, x = int(table.rank[x]), int(table.right[x])
            self.barred[token] = array("i", np.unique(np.concatenate(spans)).tobytes() if spans else b"")
        return self.barred[token]

    def _sign(self, token: int, rest: bytes) -> int:
        """A number for the set of tokens beginning with ``rest`` that cannot follow ``token``."""
        if (token, rest) not in self.known_signs:
            if rest not in self.spans:
                self.spans[rest] = bisect.bisect_left(self.sorted, rest), bisect.bisect_left(self.sorted, rest + b"\xff" * self.table.longest)
            barred, (a, b) = self._barred(token), self.spans[rest]
            some = barred[bisect.bisect_left(barred, a) : bisect.bisect_left(barred, b)].tobytes()
            self.known_signs[token, rest] = self.signs.setdefault(hashlib.blake2b(some, digest_size=16).digest() if some else b"", len(self.signs))
        return self.known_signs[token, rest]

    def _state(self, text: bytes, lasts: tuple, counts: tuple) -> int:
        """The state after ``text``, with the last token before each of its places and the number of tokens there."""
        key = [text]
        for p, (last, count) in enumerate(zip(lasts, counts)):
            rest = text[p:]
            key.append((self._sign(last, rest), count) if rest in self.prefixes else None)
        key = tuple(key)
        if key not in self.states:
            k = self.states[key] = len(self.infos)
            self.infos.append((text, lasts, counts))
            if k >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
        return self.states[key]

    def compile(self, keys: np.ndarray) -> None:
        """Adds the transitions ``keys`` (state * 256 + byte)."""
        for key in keys.tolist():
            text, lasts, counts = self.infos[key >> 8]
            text += bytes([key & 255])
            for p, last in enumerate(lasts):  # the last token now is the one that may stand behind the last token before it
                at = self.place.get(text[p:])
                if at is not None:
                    barred = self._barred(last)
                    k = bisect.bisect_left(barred, at)
                    if k == len(barred) or barred[k] != at:
                        break
            change = counts[p] + 1
            lasts, counts = (*lasts, self.table.ids[text[p:]]), (*counts, change)
            start = 0
            while text[start:] not in self.prefixes:
                start += 1
            state = self._state(text[start:], lasts[start:], tuple(c - change for c in counts[start:]))
            self.next[key >> 8, key & 255] = state
            self.emit[key >> 8, key & 255] = change

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word data[start:end]; all words advance by a byte in each step."""
        if len(self.infos) > MOST_STATES:
            self.clear()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        start, size = starts[order], size[order]
        state, count = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        active = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), "right")
        nexts, emits = self.next.ravel(), self.emit.ravel()
        for k, m in enumerate(active.tolist()):
            key = state[:m] * 256 + data[start[:m] + k]
            after = nexts[key]
            if after.min() < 0:
                self.compile(np.unique(key[after < 0]))
                nexts, emits = self.next.ravel(), self.emit.ravel()
                after = nexts[key]
            count[:m] += emits[key]
            state[:m] = after
        out = np.empty_like(count)
        out[order] = count
        return out


def token_machine(content: bytes) -> TokenMachine:
    cache = worker_cache()
    key = ("machine", hashlib.sha256(content).hexdigest())
    if key not in cache:
        cache[key] = TokenMachine(vocabulary(content))
    return cache[key]


def count_tokens(machine: TokenMachine, texts: pa.Array, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and tokens of each text; special strings are one token each and separate what is before and behind them."""
    data, offsets = flat(texts)
    n_bytes, n_tokens = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    for a, b in steps(offsets, 1 << 19):
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if not len(part):
            continue
        skip = np.zeros(len(part), bool)
        firsts = cuts[:-1][np.diff(cuts) > 0]
        found = []
        if special and machine.table.specials is not None:
            raw = part.tobytes()
            for s in sorted((s.encode() for s in machine.table.special), key=len, reverse=True):
                at = raw.find(s)
                while at >= 0:
                    row = int(np.searchsorted(cuts, at, "right")) - 1
                    if at + len(s) <= cuts[row + 1] and not skip[at : at + len(s)].any():
                        skip[at : at + len(s)] = True
                        n_tokens[a + row] += 1
                        found.append(at + len(s))
                        at = raw.find(s, at + len(s))
                    else:
                        at = raw.find(s, at + 1)
        if found:
            firsts = np.unique(np.r_[firsts, [f for f in found if f < len(part)]])
            left = ~skip
            place = np.r_[0, np.cumsum(left)]
            firsts = np.unique(place[firsts])
            part, cuts = part[left], place[cuts]
            firsts = firsts[firsts < len(part)]
            if not len(part):
                continue
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = lead[word_starts(symbols(points, np.searchsorted(lead, firsts)))]
        tokens = np.r_[0, np.cumsum(machine.counts(part, starts, np.r_[starts[1:], len(part)]))]
        at = np.searchsorted(starts, cuts)
        n_tokens[a:b] += tokens[at[1:]] - tokens[at[:-1]]
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of every whole text; null is empty.

    ``path``: a byte-level BPE tokenizer file. Special strings in a text count as one token. Further columns are not read.
    """
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data

    def run(batches):
        machine = token_machine(content.value)
        for batch in batches:
            n_bytes, n_tokens = count_tokens(machine, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
