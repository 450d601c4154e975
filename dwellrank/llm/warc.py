"""WARC archives compressed record by record with a dictionary that leads each archive.

An archive is a series of Zstandard frames: first a skippable frame that holds the dictionary, then one frame for each record.
Between records Spark's text writer puts a separator; the one used here is an empty skippable frame, which
decoders pass over. So archives are written by Spark's own committers, to any store it can write to.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the formats
DICTIONARY_FRAME = 0x184D2A5D
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payloads shorter than this are never replaced by a reference.
LEAST_REVISIT_BYTES = 100
#: Records that the dictionary is built from at most, their bytes together, and the dictionary's size.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1000, 8 << 20, 64 << 10
LEVEL = 3


def _record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, kind: str, refers_to: int | None, date: str) -> bytes:
    url = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from whole records; empty if they are too few or too small to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def compressed_records(dictionary: bytes, batches, date: str):
    """The leading frame, then a frame for each record. Batches: page_id, url, html, digest, size, kind, refers_to."""
    table = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if table is not None:
        table.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_checksum=True)
    lead = zstandard.compress(dictionary) if dictionary else b""
    first = True
    for batch in batches:
        if first and batch.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([struct.pack("<II", DICTIONARY_FRAME, len(lead)) + lead], pa.binary())], ["frame"])
            first = False
        html = batch.column(2).cast(pa.large_binary())
        frames = []
        rows = zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6)))
        for k, (page, url, digest, size, kind, refers) in enumerate(rows):
            payload = html[k].as_py() or b"" if kind == "response" else b""
            frames.append(packer.compress(_record(page, url, payload, digest, size, kind, refers, date)))
        yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["frame"])


def records(archive: bytes):
    """(headers, HTTP headers, payload) of each record of an archive."""
    magic, size = struct.unpack_from("<II", archive) if len(archive) >= 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    table = zstandard.ZstdCompressionDict(zstandard.decompress(archive[8 : 8 + size])) if size else None
    source = zstandard.ZstdDecompressor(dict_data=table).stream_reader(memoryview(archive)[8 + size :], read_across_frames=True)
    held, done = b"", False
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and not done:
            more = source.read(1 << 20)
            held, done = held + more, not more
        if end < 0:
            if held:
                raise ValueError("the archive ends within a record")
            return
        lines = held[:end].decode("utf-8").split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        stop = end + 4 + int(head["Content-Length"]) + 4
        while len(held) < stop and not done:
            more = source.read(max(1 << 20, stop - len(held)))
            held, done = held + more, not more
        if lines[0] != "WARC/1.1" or held[stop - 4 : stop] != b"\r\n\r\n":
            raise ValueError("the archive holds a broken record")
        http, _, payload = held[end + 4 : stop - 4].partition(b"\r\n\r\n")
        yield head, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload
        held = held[stop:]


def _page(name: str) -> int:
    return int(name.rsplit(":", 1)[1].rstrip(">"))


def _parsed(batches, with_payload):
    for batch in batches:
        for archive in batch.column(0):
            out, size = {n: [] for n, _ in COLUMNS}, 0
            for head, http, payload in records(archive.as_py()):
                kind = head["WARC-Type"]
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:")
                if digest != head["WARC-Payload-Digest"].removeprefix("sha256:"):
                    raise ValueError(f"the payload of {head['WARC-Record-ID']} does not have its digest")
                row = (
                    _page(head["WARC-Record-ID"]), head["WARC-Target-URI"], int(http["Content-Length"]), digest, kind,
                    _page(head["WARC-Refers-To"]) if kind == "revisit" else None, payload.decode("utf-8") if with_payload and kind == "response" else None,
                )
                for n, v in zip(out, row):
                    out[n].append(v)
                size += len(payload) * with_payload
                if size > 4 << 20 or len(out["page_id"]) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in COLUMNS], [n for n, _ in COLUMNS])
                    out, size = {n: [] for n, _ in COLUMNS}, 0
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in COLUMNS], [n for n, _ in COLUMNS])


COLUMNS = [
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string()),
]


def write_archives(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one record for each row to archives in the new folder ``path``, one for each of Spark's partitions.

    The payload is the html in UTF-8, null as empty. Of records with equal payloads of at least LEAST_REVISIT_BYTES, the one with the smallest id is
    a response and the others revisit it; shorter ones are all responses. Rows that repeat an id and a payload are all what the first is.
    Rows need an id; a null url is empty. An empty table gives no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumns({"digest": F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256), "size": F.coalesce(F.octet_length("html"), F.lit(0))})
    first = rows.where(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"))
    drawn = rows.select("page_id", "url", "html", "digest", "size").where(F.pmod(F.xxhash64("page_id"), F.lit(max(1, rows.count() // (2 * SAMPLE_RECORDS)))) == 0)
    samples, held = [], 0
    for r in drawn.limit(SAMPLE_RECORDS).collect():
        samples.append(_record(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["size"], "response", None, date))
        held += len(samples[-1])
        if held > SAMPLE_BYTES:
            break
    dictionary = build_dictionary(samples)
    kinds = rows.join(first.hint("rebalance"), "digest", "left")
    again = F.col("first") < F.col("page_id")
    kinds = kinds.select(
        "page_id", "url", "html", "digest", F.col("size").cast("long").alias("size"),
        F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to"),
    )
    frames = kinds.mapInArrow(lambda it: compressed_records(dictionary, it, date), "frame binary")
    frames.select(F.col("frame").cast("string")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, html (of responses) of every record below ``path``.

    A response's length and digest are those of the payload that was read, and are held against its headers; a revisit states those of the payload it refers to.
    """
    shape = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(lambda it: _parsed(it, with_payload), shape)
    return rows if with_payload else rows.drop("html")
