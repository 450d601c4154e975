"""NPZ files of vectors, for exchange with numpy programs, as a Spark data source.

A file holds an array of ids, a matrix with a row for each, and one JSON text
with a record for each. An uncompressed matrix is read in row ranges, each by
its own task; a compressed one is inflated by one task as it is read. Either
way a task holds a slice of rows.
"""

from __future__ import annotations

import json
import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from dwellrank import schemas
from dwellrank.sources.stores import PendingWriter, matching, opened

SLICE_BYTES = 4 << 20
RANGE_BYTES = 64 << 20
FILE_BYTES = 64 << 20
RECORDS = "records_json"


class Array:
    """A ``.npy`` member: its shape at once, its rows when asked for."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        info = archive.getinfo(f"{name}.npy")
        self.stored = info.compress_type == zipfile.ZIP_STORED
        self.handle = archive.open(info)
        version = npy.read_magic(self.handle)
        read = npy.read_array_header_1_0 if version == (1, 0) else npy.read_array_header_2_0
        self.shape, by_columns, self.dtype = read(self.handle)
        if self.dtype.hasobject:
            raise ValueError(f"{name} is a pickled array")
        if by_columns and len(self.shape) > 1:
            raise ValueError(f"{name} is stored by columns")
        self.start = self.handle.tell()
        self.row_bytes = self.dtype.itemsize * math.prod(self.shape[1:])

    def rows(self, a: int, b: int) -> np.ndarray:
        """Rows [a, b); going forward costs no more than what lies between."""
        self.handle.seek(self.start + a * self.row_bytes)
        return np.frombuffer(self.handle.read((b - a) * self.row_bytes), self.dtype).reshape(-1, *self.shape[1:])

    def text(self, step: int = 1 << 18) -> Iterator[str]:
        """The characters of a single text, piece by piece."""
        order = "be" if self.dtype.byteorder == ">" else "le"
        left = self.dtype.itemsize
        while left:
            raw = self.handle.read(min(left, step))
            if not raw:
                raise ValueError("a cut array")
            left -= len(raw)
            yield raw.decode(f"utf-32-{order}").rstrip("\0")


def objects(pieces: Iterator[str]) -> Iterator[dict]:
    """The objects of a JSON list whose text comes in pieces; one object and a piece are held."""
    decoder, held, first = json.JSONDecoder(), "", True
    for piece in pieces:
        held += piece
        while True:
            held = held.lstrip(" \t\r\n,")
            if first and held:
                if held[0] != "[":
                    raise ValueError("the records are no JSON list")
                held, first = held[1:].lstrip(" \t\r\n"), False
            if not held or held[0] == "]":
                break
            try:
                value, end = decoder.raw_decode(held)
            except json.JSONDecodeError:
                break
            yield value
            held = held[end:]
    if first or held.strip() != "]":
        raise ValueError("the records are no JSON list")


@dataclass
class Rows(InputPartition):
    """Rows [first, past) of the ``total`` ones of a file."""

    file: str
    first: int
    past: int
    total: int

    def __hash__(self):
        return hash((self.file, self.first))


class NpzReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.ids, self.matrix = options["path"], options["ids"], options["matrix"]
        self.first, self.vector, self.schema = options["first"], options["vector"], schema

    def partitions(self) -> list[Rows]:
        out = []
        for file in matching(self.path, ".npz"):
            store, place = opened(file)
            with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
                ids, matrix = Array(archive, self.ids), Array(archive, self.matrix)
                total = matrix.shape[0]
                if ids.shape != (total,) or len(matrix.shape) != 2:
                    raise ValueError(f"inconsistent lengths in {file}")
                step = max(1, RANGE_BYTES // max(1, matrix.row_bytes)) if matrix.stored else max(1, total)
                out += [Rows(file, a, min(total, a + step), total) for a in range(0, max(1, total), step)]
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        shape = to_arrow_schema(self.schema)
        store, place = opened(partition.file)
        with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            ids, matrix = Array(archive, self.ids), Array(archive, self.matrix)
            records = enumerate(objects(Array(archive, RECORDS).text()))
            step = max(1, SLICE_BYTES // max(1, matrix.row_bytes))
            for a in range(partition.first, partition.past, step):
                b = min(partition.past, a + step)
                own = []
                while len(own) < b - a:
                    at, record = next(records, (-1, None))
                    if at < 0:
                        raise ValueError(f"inconsistent lengths in {partition.file}")
                    if at >= a:
                        own.append(record)
                yield self._batch(shape, [str(x) for x in ids.rows(a, b)], own, matrix.rows(a, b))
            if partition.past == partition.total and next(records, None) is not None:
                raise ValueError(f"inconsistent lengths in {partition.file}")

    def _batch(self, shape: pa.Schema, ids: list[str], records: list[dict], rows: np.ndarray) -> pa.RecordBatch:
        columns = []
        for f in shape:
            if f.name == self.first:
                columns.append(pa.array(ids, f.type))
            elif f.name == self.vector:
                flat = pa.array(rows.astype(np.float32).ravel())
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), flat).cast(f.type))
            else:
                columns.append(pa.array([r.get(f.name) for r in records], f.type))
        return pa.RecordBatch.from_arrays(columns, schema=shape)


class NpzWriter(PendingWriter):
    """Files of at most FILE_BYTES of vectors; rows are (id, vector, record as JSON)."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        super().__init__(options["path"], ".npz", overwrite)
        self.ids, self.matrix = options["ids"], options["matrix"]

    def files(self, batches: Iterator[pa.RecordBatch], create) -> int:
        rows, held, size = 0, [], 0

        def save():
            ids, vectors, records = ([v for part in held for v in part[k]] for k in range(3))
            if len({len(v) for v in vectors}) > 1:
                raise ValueError("vectors of different lengths")
            arrays = {self.ids: np.asarray(ids, str), self.matrix: np.asarray(vectors, np.float32), RECORDS: np.asarray("[" + ",".join(records) + "]")}
            with create() as out:
                np.savez_compressed(out, **arrays)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append([c.to_pylist() for c in part.columns])
                rows += part.num_rows
                size += part.nbytes
                if size >= FILE_BYTES:
                    save()
                    held, size = [], 0
        if held:
            save()
        return rows


class Npz(DataSource):
    """Options ``path``, ``ids`` and ``matrix`` (names of the arrays), ``first`` and ``vector`` (the columns they become)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(dict(self.options), overwrite)


def _read(spark: SparkSession, path: str, ddl: str, ids: str, matrix: str, first: str, vector: str) -> DataFrame:
    spark.dataSource.register(Npz)
    matching(path, ".npz")
    return spark.read.format("npz").schema(ddl).options(path=path, ids=ids, matrix=matrix, first=first, vector=vector).load()


def read_embedding_npz(spark: SparkSession, path: str) -> DataFrame:
    """Embedding files (a path, a folder or a glob) (S10). Pickled object arrays are refused."""
    return _read(spark, path, schemas.EMBEDDING_DDL, "ids", "embeddings", "embedding_id", "vec")


def read_query_npz(spark: SparkSession, path: str) -> DataFrame:
    """Question vector files."""
    return _read(spark, path, schemas.QUERY_DDL, "example_ids", "queries", "example_id", "qvec")


def write_npz(df: DataFrame, path: str, id_column: str, vector: str, ids_name: str, matrix_name: str) -> DataFrame:
    """NPZ files in a folder, at least one for each partition with rows (K7, K8); gives their names and rows. No row at all is an error."""
    spark = df.sparkSession
    spark.dataSource.register(Npz)
    record = F.to_json(F.struct(*[c for c in df.columns if c != vector]), {"ignoreNullFields": "false"})
    rows = df.select(F.col(id_column).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"), record.alias("record"))
    rows.write.format("npz").mode("overwrite").options(path=path, ids=ids_name, matrix=matrix_name).save()
    out = []
    try:
        names = matching(path, ".npz")
    except FileNotFoundError:
        raise ValueError(f"no vectors were written to {path}") from None
    for file in names:
        store, place = opened(file)
        with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
            out.append((file, Array(archive, ids_name).shape[0]))
    return spark.createDataFrame(out, "path string, rows bigint")
