"""Helpers the operators share: written intermediates, flat text buffers, word and shingle hashes, connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; its temporary arrays take some thirty times as much.
STEP_BYTES = 1 << 19

#: The white space of all contracts: blank and tab to carriage return.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder in the folder that ``spark.checkpoint.dir`` names; a temporary one only on a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="dwellrank-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when an executor is lost."""
    spark = df.sparkSession
    path = shared_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, for compiled tables."""
    return sys.__dict__.setdefault("_llm_tables", {})


def trimmed() -> None:
    """Gives back what earlier tasks of this Python worker have freed; workers live on from stage to stage, and allocators keep pages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def relieved(results: Iterator) -> Iterator:
    """Passes a worker function's results on, then gives back what it has freed: the worker stays while stages without Python run beside it."""
    yield from results
    trimmed()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text is a run of its own."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(stop, rows)
        row = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTOR = 0x2545F4914F6CDD1D  # odd, so it has an inverse modulo 2 ** 64


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, kept by the worker."""
    cache = worker_cache()
    if len(cache.get("powers", ((), ()))[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for base in (FACTOR, pow(FACTOR, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        cache["powers"] = tuple(both)
    p, q = cache["powers"]
    return p[:n], q[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each text the number of words before it."""
    solid = ~BLANK[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[LOWER[data]] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def exact_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes as it stands."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``width`` words; a shorter text's words are one shingle."""
    starts, ends, bounds = word_spans(data, offsets)
    h = word_hashes(data, starts, ends)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled[: max(0, n - k)] += mixed(h[k:] + np.uint64(k + 1)) * np.uint64(2 * k + 1)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            s = np.sort(rolled[a : b - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            out.append(mixed(np.array([(mixed(h[a:b] + place) * (place + place + np.uint64(b - a))).sum()], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def components(links: DataFrame, purpose: str) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id that can be reached.

    Alternating large-star and small-star rounds, each written to the shared folder; about log2 of the longest chain rounds.
    Every round sends each link once. A group of any size is a stream of links, and minima are combined before they are sent.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, purpose)
    while True:
        # large star: neighbours above a node are tied to its smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).hint("rebalance")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node's smaller neighbours and the node are tied to the smallest of them
        floor = large.groupBy("a").agg(F.min("b").alias("m")).hint("rebalance")
        small = large.join(floor, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, purpose)
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        before, now = (df.agg(F.count("*"), total).first() for df in (edges, after))
        edges = after
        if before == now:
            break
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
