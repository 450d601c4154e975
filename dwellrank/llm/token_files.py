"""Token ids in binary files of patched frame-of-reference blocks.

A file is a series of segments, each with whole documents:

    magic, bytes of the segment, part, ids before it in its part, documents, ids, blocks      (header)
    id, validity and number of tokens of each document                                         (document table)
    where each block starts, and where the last one ends                                       (block index)
    blocks, then one closing byte

A block holds BLOCK ids: their minimum is subtracted, the differences are packed at the number of bits that PERCENTILE percent
of them fit in, and what the others have beyond it goes to an exception list (places and high bits). Blocks have different lengths, so
the index of their starts lets a reader take any range of ids without unpacking the rest.

The closing byte is the line separator of Spark's text writer, which writes the files: by Spark's own committers, to any store.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellrank.llm.bpe import byte_of_character
from dwellrank.llm.common import exact_hashes, flat, steps, worker_cache
from dwellrank.llm.transducer import symbols, word_starts

#: Ids of a block (places in an exception list are single bytes), and the share of them, in percent, that sets its width.
BLOCK, PERCENTILE = 256, 90
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18
#: Bytes of text in a file, and in the smaller files that are made while there are fewer of them than shuffle partitions.
FILE_BYTES, LEAST_FILE_BYTES = 128 << 20, 4 << 20
#: Words whose ids a worker keeps, in arrays of some 60 bytes each; beyond that it starts anew.
KEPT_WORDS = 1_000_000
#: Words that the model encodes at a time.
JOINED = 64

# fixed values of the format
MAGIC, CLOSING = b"PFB1", "\n"
HEADER = "<4sQIQIQI"
HEADER_BYTES = struct.calcsize(HEADER)
BLOCK_HEADER = np.dtype([("low", "<u4"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2")])


def _bits(x: np.ndarray) -> np.ndarray:
    """The number of bits of each value."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, where each block starts and the last one ends). The last block is filled up with its minimum."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    grid = np.empty(n * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids) :] = ids[(n - 1) * BLOCK :].min()
    grid = grid.reshape(n, BLOCK)
    low = grid.min(1)
    over = grid - low[:, None]
    at = max(0, -(-BLOCK * percentile // 100) - 1)
    width = _bits(np.partition(over, at, axis=1)[:, at])
    high = (over.astype(np.uint64) >> width.astype(np.uint64)[:, None]).astype(np.uint32)
    block, place = np.nonzero(high)
    exceptions = np.bincount(block, minlength=n)
    payload = BLOCK // 8 * width
    starts = np.r_[0, np.cumsum(BLOCK_HEADER.itemsize + payload + 5 * exceptions)]
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros(n, BLOCK_HEADER)
    head["low"], head["width"], head["exceptions"] = low, width, exceptions
    out[starts[:-1, None] + np.arange(BLOCK_HEADER.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        bits = (over[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        out[(starts[rows] + BLOCK_HEADER.itemsize)[:, None] + np.arange(packed.shape[1])] = packed
    rank = np.arange(len(block)) - np.searchsorted(block, block)
    lists = starts[block] + BLOCK_HEADER.itemsize + payload[block]
    out[lists + rank] = place
    out[(lists + exceptions[block] + 4 * rank)[:, None] + np.arange(4)] = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that start at ``starts`` in ``data``, the filling of the last one included."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(BLOCK_HEADER.itemsize)].view(BLOCK_HEADER).ravel()
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    out = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = data[(starts[rows] + BLOCK_HEADER.itemsize)[:, None] + np.arange(BLOCK // 8 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        for k in range(w):
            out[rows] |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    block = np.repeat(np.arange(n), exceptions)
    rank = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    lists = starts[block] + BLOCK_HEADER.itemsize + BLOCK // 8 * width[block]
    place = data[lists + rank].astype(np.int64)
    high = data[(lists + exceptions[block] + 4 * rank)[:, None] + np.arange(4)].view("<u4").ravel()
    out[block, place] |= (high.astype(np.uint64) << width[block].astype(np.uint64)).astype(np.uint32)
    return (out + head["low"][:, None]).ravel()


def segment(part: int, before: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one segment, its closing byte excepted."""
    data, starts = pack_blocks(ids)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], "u1").tobytes() + np.array(lengths, "<u4").tobytes()
    index = starts.astype("<u8").tobytes()
    size = HEADER_BYTES + len(table) + len(index) + len(data)
    return struct.pack(HEADER, MAGIC, size, part, before, len(doc_ids), len(ids), len(starts) - 1) + table + index + data.tobytes()


class Segment:
    """A segment of a file that has been read: its documents at once, its ids when asked for."""

    def __init__(self, content: memoryview, at: int):
        magic, size, self.part, self.before, n, self.ids, blocks = struct.unpack_from(HEADER, content, at)
        if magic != MAGIC or at + size >= len(content) or content[at + size] != CLOSING.encode()[0]:
            raise ValueError("not a segment of token ids, or a cut one")
        self.end, at = at + size + 1, at + HEADER_BYTES
        known = np.frombuffer(content, "u1", n, at + 8 * n)
        self.doc_ids = pa.array(np.frombuffer(content, "<i8", n, at), pa.int64(), mask=known == 0)
        self.lengths = np.frombuffer(content, "<u4", n, at + 9 * n).astype(np.int64)
        at += 13 * n
        self.starts = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.data = np.frombuffer(content, np.uint8, int(self.starts[-1]), at + 8 * (blocks + 1))

    def between(self, first: int, last: int) -> np.ndarray:
        """The ids from place ``first`` up to ``last``, exclusive; only the blocks that hold them are unpacked."""
        a = first // BLOCK
        return unpack_blocks(self.data, self.starts[:-1][a : -(-last // BLOCK)])[first - a * BLOCK : last - a * BLOCK]


def segments(content: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        found = Segment(view, at)
        yield found
        at = found.end


class Encoder:
    """Ids as the tokenizers library gives them. Texts are cut into the words the library would cut them into; its model encodes each new word."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has the core it runs on
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_of_character().items()}
        tokens = self.library.get_vocab()
        self.size = np.zeros(max(tokens.values()) + 1, np.int64)
        self.size[list(tokens.values())] = [len(t) for t in tokens]
        blank = self.letters[0x20]
        #: Bytes that stand before a blank within some token; words that end in one aren't joined to the next.
        bytes_of = {c: b for b, c in self.letters.items()}
        self.sticky = {bytes_of[before] for t in tokens for before, c in zip(t, t[1:]) if c == blank and before in bytes_of}
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.id_ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.bytes, self.byte_ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def _model_ids(self, text: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize(text.decode("latin-1").translate(self.letters))]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Adds words to the table. Words with a leading blank go to the model many at a time: no merge crosses from one to the next."""
        lone = [not (w[0] == 0x20 and w[-1] not in self.sticky and w.rfind(b" ") == 0) for w in words]
        order = [k for k, alone in enumerate(lone) if alone] + [k for k, alone in enumerate(lone) if not alone]
        words, keys, split = [words[k] for k in order], keys[order], sum(lone)
        collecting = gc.isenabled()
        gc.disable()  # the many small objects from the model are freed by their counts
        try:
            ids = [i for w in words[:split] for i in self._model_ids(w)]
            ids += [i for k in range(split, len(words), JOINED) for i in self._model_ids(b"".join(words[k : k + JOINED]))]
        finally:
            if collecting:
                gc.enable()
        byte_ends = np.cumsum([len(w) for w in words])
        new = np.array(ids, np.uint32)
        id_ends = np.searchsorted(np.cumsum(self.size[new]), byte_ends) + 1
        rows = np.arange(len(words)) + len(self.rows)
        self.ids, self.id_ends = np.r_[self.ids, new], np.r_[self.id_ends, len(self.ids) + id_ends]
        self.bytes, self.byte_ends = np.r_[self.bytes, np.frombuffer(b"".join(words), np.uint8)], np.r_[self.byte_ends, len(self.bytes) + byte_ends]
        self.keys, self.rows = np.r_[self.keys, keys], np.r_[self.rows, rows]
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.rows = self.keys[order], self.rows[order]

    def _by_library(self, text: bytes) -> bytes:
        return np.array(self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
        """(first row, little-endian ids of the rows from there on), by portions of bounded text; null is empty.

        Words are looked up by hash, and the bytes found are held against the text's; where they differ, the library encodes the text.
        """
        data, offsets = flat(texts)
        for a, b in steps(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            raw = part.tobytes()
            if not raw:
                yield a, [b""] * (b - a)
                continue
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
            firsts = cuts[:-1][np.diff(cuts) > 0]
            starts = lead[word_starts(symbols(points, np.searchsorted(lead, firsts)))]
            ends = np.r_[starts[1:], len(raw)]
            if len(self.rows) > KEPT_WORDS:
                self._forget()
            keys, first, back = np.unique(exact_hashes(part, starts, ends), return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
            if len(new):
                self._learn(keys[new], [raw[i:j] for i, j in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
                at = np.searchsorted(self.keys, keys)
            row = self.rows[at][back]
            n = self.byte_ends[row + 1] - self.byte_ends[row]
            odd = {int(np.searchsorted(cuts, k, "right")) - 1 for s in self.special for k in _places(raw, s)}  # special strings divide a text first
            if not (n == ends - starts).all() or not (self.bytes[np.arange(len(raw)) + np.repeat(self.byte_ends[row] - starts, n)] == part).all():
                odd = range(b - a)
            n = self.id_ends[row + 1] - self.id_ends[row]
            to = np.r_[0, np.cumsum(n)]
            ids = self.ids[np.arange(to[-1]) + np.repeat(self.id_ends[row] - to[:-1], n)].astype("<u4", copy=False).tobytes()
            edges = (4 * to[np.searchsorted(starts, cuts)]).tolist()
            out = [ids[i:j] for i, j in zip(edges, edges[1:])]
            for k in odd:
                out[k] = self._by_library(raw[cuts[k] : cuts[k + 1]])
            yield a, out


def encoder(content: bytes) -> Encoder:
    """One for each worker."""
    key = ("token files", zlib.crc32(content), len(content))
    cache = worker_cache()
    if key not in cache:
        cache[key] = Encoder(content)
    return cache[key]


def _places(raw: bytes, s: bytes) -> Iterator[int]:
    at = raw.find(s) if s else -1
    while at >= 0:
        yield at
        at = raw.find(s, at + 1)


def _packed(batches, content: bytes, end_id: int):
    """The segments of one file, from rows (doc_id, text) in order."""
    words, end = encoder(content), np.uint32(end_id).tobytes()
    part, before = TaskContext.get().partitionId(), 0
    names: list[int | None] = []
    lengths: list[int] = []
    held: list[bytes] = []

    def closed():
        nonlocal before, names, lengths, held
        ids = np.frombuffer(b"".join(held), "<u4")
        row = pa.RecordBatch.from_arrays([pa.array([segment(part, before, names, lengths, ids)], pa.binary())], ["segment"])
        before, names, lengths, held = before + len(ids), [], [], []
        return row

    size = 0
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, rows in words.encode(batch.column(1)):
            for k, raw in enumerate(rows):
                names.append(ids[first + k])
                held += (raw, end)
                lengths.append(len(raw) // 4 + 1)
                size += lengths[-1]
                if size >= SEGMENT_IDS:
                    yield closed()
                    size = 0
    if names:
        yield closed()


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, ``end_id`` after each, to files in the new folder ``path``, in ascending order of ids over all files.

    ``tokenizer``: a file of the tokenizers library; ids are its encoding without added special tokens, truncation or padding. A null text is empty: its
    end id alone. Rows without an id come last; rows of one id are ordered by their text, null first. An empty table gives no file. Further columns are not read.
    Texts are dealt by ranges of id and text, so that rows of one id, however many, may lie in several files. Each file comes from one task
    that holds one segment of at most SEGMENT_IDS ids and a document.
    """
    spark = docs.sparkSession
    with open(tokenizer, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the data
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    files = max(1, size // FILE_BYTES, min(size // LEAST_FILE_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("text").asc_nulls_first()]
    rows = rows.repartitionByRange(files, *order[:2]).sortWithinPartitions(*order)
    packed = rows.mapInArrow(lambda it: _packed(it, content.value, end_id), "segment binary")
    packed.select(F.col("segment").cast("string")).write.option("lineSep", CLOSING).text(path)


def _documents(batches, with_ids):
    for batch in batches:
        for content in batch.column(0):
            for s in segments(content.as_py()):
                ids = s.between(0, s.ids).astype("<u4", copy=False)
                ends = np.cumsum(s.lengths)
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - s.lengths).tolist(), ends.tolist())]
                columns = [s.doc_ids, pa.array(np.full(len(ends), s.part, np.int32)), pa.array(s.before + ends - s.lengths), pa.array(s.lengths), pa.array(crc, pa.int64())]
                names = ["doc_id", "part", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)


def _parts(batches):
    """(part, ids) of each segment, from the headers alone."""
    for batch in batches:
        found = [(s.part, s.ids) for content in batch.column(0) for s in segments(content.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int64())], ["part", "n"])


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files below ``path``: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids.

    Places within a file come from the file; ids before it from the totals of the files, of which there is one row each, summed in groups of 1,024.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    shape = "doc_id long, part int, within long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = files.mapInArrow(lambda it: _documents(it, with_ids), shape)
    totals = files.mapInArrow(_parts, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).withColumn("some", F.expr("part div 1024"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = totals.groupBy("some").agg(F.sum("n").alias("n")).select("some", ahead(Window.orderBy("some")).alias("of_groups"))
    before = totals.withColumn("of_files", ahead(Window.partitionBy("some").orderBy("part"))).join(groups, "some")
    before = before.select("part", (F.col("of_groups") + F.col("of_files")).alias("before"))
    rows = rows.join(before.hint("rebalance"), "part")
    return rows.select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)
