"""Zipped CSV as a Spark data source.

Deflated data cannot be entered in the middle, so a partition is a member of an
archive. It is inflated and parsed as it is read, in batches of a few megabytes:
the memory of a task is that of a batch, whatever the size of the archive.
"""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from dwellrank.sources.stores import PendingWriter, matching, opened

BLOCK_BYTES = 4 << 20


def members(archive: zipfile.ZipFile) -> list[str]:
    """The CSV files of an archive, in its order."""
    return [n for n in archive.namelist() if n.endswith(".csv") and not n.startswith("__MACOSX")]


def member_header(file: str, member: str | None = None) -> list[str]:
    """The column names in the first line of a member (the first one)."""
    store, place = opened(file)
    with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:
        if not (found := members(archive)):
            return []
        with archive.open(member or found[0]) as handle:
            return _first_row(handle)


def _first_row(handle) -> list[str]:
    rows = csv.open_csv(handle, csv.ReadOptions(autogenerate_column_names=True, block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True))
    first = rows.read_next_batch().slice(0, 1).to_pylist()[0]
    return ["" if v is None else str(v) for v in first.values()]


@dataclass
class Member(InputPartition):
    """One CSV file of one archive."""

    file: str
    name: str

    def __hash__(self):
        return hash((self.file, self.name))


class ZippedReader(DataSourceReader):
    def __init__(self, path: str, header: list[str], wanted: list[str], schema: StructType):
        self.path, self.header, self.wanted, self.names = path, header, wanted, [f.name for f in schema.fields]

    def partitions(self) -> list[Member]:
        out = []
        for file in matching(self.path, ".zip"):
            store, place = opened(file)
            with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive:  # the directory at the end of the file alone is read
                out += [Member(file, n) for n in members(archive)]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if member_header(partition.file, partition.name) != self.header:
            raise ValueError(f"{partition.file} has other columns than the first archive")
        store, place = opened(partition.file)
        own = [f"c{k}" for k in range(len(self.header))]
        picked = [own[self.header.index(c)] for c in self.wanted] if self.wanted else own
        texts = csv.ConvertOptions(column_types={c: pa.string() for c in own}, include_columns=picked, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=True)
        with store.open_input_file(place) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as handle:
            rows = csv.open_csv(handle, csv.ReadOptions(column_names=own, skip_rows=1, block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True), texts)
            at = 0
            for batch in rows:
                n = batch.num_rows
                place_in = pa.StructArray.from_arrays(
                    [pa.array([f"{partition.file}/{partition.name}"] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())],
                    ["file", "block", "row"])
                yield pa.RecordBatch.from_arrays([*batch.columns, place_in], self.names)
                at += n


class ZippedWriter(PendingWriter):
    """An archive with one member for each task, deflated as the rows arrive; no rows, an archive with the header alone."""

    def __init__(self, path: str, names: list[str], overwrite: bool):
        super().__init__(path, ".csv.zip", overwrite)
        self.names = names

    def files(self, batches: Iterator[pa.RecordBatch], create) -> int:
        rows = 0
        shape = pa.schema([(n, pa.string()) for n in self.names])
        with create() as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive, archive.open("rows.csv", "w", force_zip64=True) as member:
            with csv.CSVWriter(member, shape) as lines:
                for batch in batches:
                    lines.write_batch(pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.columns], schema=shape))
                    rows += batch.num_rows
        return rows


class ZippedCsv(DataSource):
    """``path``: an archive, a folder or a glob of them. ``header`` and ``columns``: JSON lists of all and of the wanted raw column names."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(self.options["path"], json.loads(self.options["header"]), json.loads(self.options.get("columns", "[]")), schema)

    def writer(self, schema: StructType, overwrite: bool) -> ZippedWriter:
        return ZippedWriter(self.options["path"], [f.name for f in schema.fields], overwrite)
