"""Rows of Arrow columns, read one at a time, and columns made of rows.

An Arrow batch has ten thousand rows, however long they are. Functions over
texts read a row when they need it and pass results on in portions, so a
worker holds the batch as it came and one portion, not Python objects of it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Items of results that a function holds before it passes them on.
PORTION = 1 << 18


def give_back() -> None:
    """Returns freed memory to the system: several workers of a task run side by side, and their allocators keep what a batch took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def list_rows(column: pa.ListArray) -> Iterator[np.ndarray | list | None]:
    """The items of every row: numbers as an array, anything else as a list; None for a null row."""
    items, ends, there = column.values, column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    numbers = pa.types.is_integer(items.type) or pa.types.is_floating(items.type)
    for a, b, valid in zip(ends[:-1].tolist(), ends[1:].tolist(), there.tolist()):
        part = items.slice(a, b - a)
        yield None if not valid else part.to_numpy(zero_copy_only=False) if numbers else part.to_pylist()


def matrix_rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Every row of vectors of one length as a matrix."""
    vectors, ends = column.values, column.offsets.to_numpy()
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        flat = vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False)
        yield flat.reshape(b - a, -1) if b > a else flat.reshape(0, 0)


def list_column(rows: list, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    """Arrays of numbers as a column; None is a null row."""
    return listed(pa.array(np.concatenate([r for r in rows if r is not None] or [np.empty(0)]), kind, safe=False), rows)


def matrix_column(rows: list[np.ndarray], kind: pa.DataType = pa.float32()) -> pa.ListArray:
    """Matrices of any heights as a column of lists of vectors."""
    vectors = [v for m in rows for v in m]
    return listed(list_column(vectors, kind), rows)


def struct_column(rows: list, names: tuple[str, ...], kind: pa.DataType) -> pa.ListArray:
    """Matrices with a column per name as a column of lists of structs; None is a null row."""
    flat = np.concatenate([r for r in rows if r is not None] or [np.empty((0, len(names)))])
    return listed(pa.StructArray.from_arrays([pa.array(flat[:, k], kind, safe=False) for k in range(len(names))], list(names)), rows)


def listed(items: pa.Array, rows: list) -> pa.ListArray:
    """Items of all rows as a column of lists; None is a null row."""
    sizes = np.array([0 if r is None else len(r) for r in rows], np.int64)
    missing = pa.array([r is None for r in rows], pa.bool_()) if any(r is None for r in rows) else None
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), items, mask=missing)
