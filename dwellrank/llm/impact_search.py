"""Ranked lexical search with range-maximum tables over posting lists.

Documents are indexed in shards. In a shard every term of the queries has a posting list in the order of the documents' ids, with the impact (the term's share
in the document's score) of each posting, and a sparse table that gives the greatest impact in any range of the list at once. A query starts
with the interval of all documents of the shard; the sum of its terms' range maxima bounds every score in it. Best first, intervals are split at
the document with their greatest impact: that document is scored, and what is before and behind it are two new intervals. An interval whose bound cannot reach the
best scores any more is never opened.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwellrank.llm.common import LOWER, flat, steps, word_hashes, written

#: Documents and postings of a shard at most (a document's own postings may go beyond).
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 20
#: Intervals that are split in one step, best bounds first.
WIDTH = 64
#: Bytes of query text that are searched for in one pass over the documents.
PASS_BYTES = 8 << 20
#: One shard in so many is searched first, for scores that the results surely reach.
FIRST_SHARE = 16

#: The bytes of terms: letters and digits of ASCII, and all bytes of other characters.
SOLID = np.zeros(256, bool)
SOLID[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query_terms(text: str | None) -> list[bytes]:
    """The distinct terms of a query, A-Z lower-cased."""
    found = re.findall(TERM, text or "")
    return sorted({bytes(LOWER[np.frombuffer(t.encode(), np.uint8)]) for t in found})


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all terms, and for each text the number of terms before it."""
    solid = SOLID[data]
    before, after = np.r_[False, solid[:-1]], np.r_[solid[1:], False]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


class Gathered:
    """The documents of a shard to be."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.known: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.postings: list[np.ndarray] = []
        self.docs = self.count = 0

    def add(self, ids, known, sizes, doc, term, tf):
        self.postings.append(np.stack([doc + self.docs, term, tf]))
        self.ids.append(ids)
        self.known.append(known)
        self.sizes.append(sizes)
        self.docs += len(ids)
        self.count += len(doc)

    def row(self) -> pa.RecordBatch:
        """Documents in ascending order of their ids, those without one last; postings by term, then document."""
        ids, known, sizes = (np.concatenate(x) for x in (self.ids, self.known, self.sizes))
        order = np.lexsort((ids, ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc, term, tf = np.concatenate(self.postings, axis=1)
        doc = place[doc]
        by = np.argsort(term * len(ids) + doc, kind="stable")
        terms, counts = np.unique(term, return_counts=True)
        values = {
            "n_docs": (len(ids), pa.int64()), "n_terms": (int(sizes.sum()), pa.int64()), "ids": (ids[order].astype("<i8").tobytes(), pa.binary()),
            "known": (known[order].astype("u1").tobytes(), pa.binary()), "sizes": (sizes[order].astype("<i8").tobytes(), pa.binary()),
            "terms": (terms.tolist(), pa.list_(pa.int32())), "counts": (counts.tolist(), pa.list_(pa.int64())),
            "docs": (doc[by].astype("<i4").tobytes(), pa.binary()), "tfs": (tf[by].astype("<i4").tobytes(), pa.binary()),
        }
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values.values()], list(values))


SHARD = "n_docs long, n_terms long, ids binary, known binary, sizes binary, terms array<int>, counts array<long>, docs binary, tfs binary"


def _shards(batches, hashes, places):
    """Shards of the documents with terms; ``hashes`` (sorted) and ``places`` of the terms that queries ask for."""
    held = Gathered()
    for batch in batches:
        all_ids = batch.column(0)
        known = ~np.asarray(all_ids.is_null())
        all_ids = all_ids.fill_null(0).to_numpy(zero_copy_only=False)
        data, offsets = flat(batch.column(1))
        for a, b in steps(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if not len(part):
                continue
            starts, ends, bounds = term_spans(part, cuts)
            h = word_hashes(part, starts, ends)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            hit = np.flatnonzero(hashes[at] == h) if len(hashes) else np.zeros(0, np.int64)
            sizes = np.diff(bounds)
            has = np.flatnonzero(sizes)
            number = np.zeros(b - a, np.int64)
            number[has] = np.arange(len(has))
            doc = number[np.repeat(np.arange(b - a), sizes)[hit]]
            key, tf = np.unique(doc * max(1, len(hashes)) + places[at[hit]], return_counts=True)
            held.add(all_ids[a:b][has], known[a:b][has], sizes[has], key // max(1, len(hashes)), key % max(1, len(hashes)), tf)
            if held.docs >= SHARD_DOCS or held.count >= SHARD_POSTINGS:
                yield held.row()
                held = Gathered()
    if held.docs:
        yield held.row()


class Shard:
    """The posting lists of one shard with their impacts and range-maximum tables."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], "u1") > 0
        self.n = len(self.ids)
        terms, counts = np.array(row["terms"], np.int64), np.array(row["counts"], np.int64)
        doc, tf = np.frombuffer(row["docs"], "<i4").astype(np.int64), np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        term = np.repeat(terms, counts)
        self.keys = term * self.n + doc
        self.doc = doc
        self.begin = np.zeros(len(weights) + 1, np.int64)
        self.begin[terms + 1] = counts
        self.begin = np.cumsum(self.begin)
        length = 10 + 90 * np.frombuffer(row["sizes"], "<i8") * n_docs // n_terms
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * length[doc]))
        self.table = [np.arange(len(doc), dtype=np.int32)]
        while 2 << (len(self.table) - 1) <= counts.max(initial=0):
            row_, reach = self.table[-1], 1 << (len(self.table) - 1)
            left, right = row_[:-reach], row_[reach:]
            best = row_.copy()  # the last places begin no range of this length
            best[:-reach] = np.where(self.impact[left] >= self.impact[right], left, right)
            self.table.append(best)
        self.table = np.stack(self.table)

    def maxima(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, value) of the greatest impact in each range of postings; 0 for empty ranges."""
        size = b - a
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        full = size > 0
        a = np.where(full, a, 0)
        x, y = self.table[level, a], self.table[level, np.where(full, b - (1 << level), 0)]
        place = np.where(self.impact[x] >= self.impact[y], x, y)
        return place, np.where(full, self.impact[place], 0)

    def search(self, terms: np.ndarray, best: list[tuple[int, float, int | None]], k: int, least: int) -> None:
        """Puts into ``best`` (sorted; minus score, id for the order, id) the shard's documents that are among the k best. No result is below ``least``."""
        terms = terms[self.begin[terms + 1] > self.begin[terms]]
        if not len(terms):
            return
        a, b = self.begin[terms][None], self.begin[terms + 1][None]
        lo, hi = np.zeros(1, np.int64), np.full(1, self.n)
        place, value = self.maxima(a, b)
        bound = value.sum(1)
        base = terms * self.n
        while len(lo):
            score_k, id_k = (-best[-1][0], best[-1][1]) if len(best) == k else (least, math.inf)
            first = np.where(self.known[lo], self.ids[lo], np.inf)
            open_ = (bound > 0) & ((bound > score_k) | ((bound == score_k) & (first <= id_k)))
            if not open_.all():
                lo, hi, a, b, place, value, bound = (x[open_] for x in (lo, hi, a, b, place, value, bound))
            if not len(lo):
                return
            chosen = np.argpartition(-bound, WIDTH)[:WIDTH] if len(bound) > WIDTH else np.arange(len(bound))
            rest = np.ones(len(bound), bool)
            rest[chosen] = False
            at = self.doc[place[chosen, np.argmax(value[chosen], 1)]]
            key = base[None] + at[:, None]
            split = np.searchsorted(self.keys, key)
            there = self.keys[np.minimum(split, len(self.keys) - 1)] == key
            there &= split < len(self.keys)
            scores = np.where(there, self.impact[np.minimum(split, len(self.keys) - 1)], 0).sum(1)
            for s, d in zip(scores.tolist(), at.tolist()):
                if s >= score_k and s > 0:
                    name = int(self.ids[d]) if self.known[d] else None
                    best.append((-s, math.inf if name is None else name, name))
            best.sort(key=lambda r: r[:2])
            del best[k:]
            lo2, hi2 = np.r_[lo[chosen], at + 1], np.r_[at, hi[chosen]]
            a2, b2 = np.r_[a[chosen], split + there], np.r_[split, b[chosen]]
            some = lo2 < hi2
            lo2, hi2, a2, b2 = (x[some] for x in (lo2, hi2, a2, b2))
            place2, value2 = self.maxima(a2, b2)
            lo, hi, a, b = np.r_[lo[rest], lo2], np.r_[hi[rest], hi2], np.r_[a[rest], a2], np.r_[b[rest], b2]
            place, value, bound = np.r_[place[rest], place2], np.r_[value[rest], value2], np.r_[bound[rest], value2.sum(1)]


def _searched(batches, queries, weights, n_docs, n_terms, k, least):
    """The k best documents of all shards of a task for each query."""
    best: list[list] = [[] for _ in queries]
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row, weights, n_docs, n_terms)
            for q, terms in enumerate(queries):
                shard.search(terms, best[q], k, least[q])
    rows = [(q, r[2], -r[0]) for q, found in enumerate(best) for r in found]
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["query", "doc_id", "score"])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _one_pass(source: DataFrame, items: list, k: int) -> DataFrame:
    spark = source.sparkSession
    terms_of = [query_terms(r["text"]) for r in items]
    vocabulary = sorted({t for terms in terms_of for t in terms})
    ends = np.cumsum([len(t) for t in vocabulary], dtype=np.int64)
    data = np.frombuffer(b"".join(vocabulary), np.uint8)
    h = word_hashes(data, ends - [len(t) for t in vocabulary], ends) if vocabulary else np.zeros(0, np.uint64)
    places = np.argsort(h)
    hashes = h[places]
    index = written(source.mapInArrow(lambda it: _shards(it, hashes, places), SHARD), "impact-shards")

    total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    for r in held.collect():  # a row for each term of this pass's queries
        df[r["terms"]] = r["n"]
    weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    at = {t: i for i, t in enumerate(vocabulary)}
    queries = [np.array([at[t] for t in terms], np.int64) for terms in terms_of]

    def search(shards, least):
        return shards.mapInArrow(lambda it: _searched(it, queries, weights, total["docs"], total["terms"], k, least), "query long, doc_id long, score long")

    least = [0] * len(items)
    some = search(index.where(F.pmod(F.xxhash64("ids"), F.lit(FIRST_SHARE)) == 0), least)
    for r in _ranked(some, k).where(F.col("rank") == k).collect():  # a row for each query
        least[r["query"]] = r["score"]
    names = spark.createDataFrame([(q, r["item_id"]) for q, r in enumerate(items)], "query long, item_id long")
    found = _ranked(search(index, least), k)
    return found.join(names, "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the ``k`` best documents of each item, of all documents and whole texts.

    Terms are the maximal matches of TERM, A-Z lower-cased. A term of weight w = floor(1000 * ln((2 N + 2) / (2 df + 1))) that is tf times in a document of n
    terms adds w * (10^9 tf div (1000 tf + 8 m)) with m = 10 + (90 n N div L); N counts the documents with terms, L their terms. Only scores above 0 are results; equal
    ones are ordered by ascending id, null last. Null texts have no terms. Items without terms, and all if no document has one, have no result; rows that repeat an
    item's id are items of their own, documents that repeat an id are documents of their own. Further columns are not read.

    Items are taken in passes of about PASS_BYTES of their texts, so what a pass sends to the tasks and gets from them has a bound. Words are told
    apart by 64-bit hashes. What a task returns is k rows a query at most; a first search of some of the shards gives scores that later ones must reach.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = -(-size // PASS_BYTES)
    if not passes:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    turn = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    return reduce(DataFrame.unionByName, (_one_pass(source, asked.where(turn == p).collect(), k) for p in range(passes)))
