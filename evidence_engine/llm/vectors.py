"""Vectors as exact integers: which rows count, and their components as numpy blocks or, where those overflow, Python integers.

A row is narrow if all its integers lie below a limit that keeps sums of products within 64 bits; its integers are then
stored as little-endian 32-bit integers. The others are wide: stored as text, and counted with Python integers, so that
any finite component has an exact result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The range of the long type; results beyond it count as its nearest end.
LONG = 2**63 - 1


def finite(vector: Column) -> Column:
    """Whether a vector is not null and has no component that is null, infinite or no number."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))


def limit_of(width: int) -> int:
    """Integers below this in size have squared distances and inner products of width terms below 2**62."""
    return min(2**31 - 1, math.isqrt(2**60 // max(width, 1)))


def whole(x: float, scale: int) -> int:
    return math.floor(Fraction(x) * scale)


def with_integers(rows: DataFrame, vector: str, width: int, scale: int, limit: int | None = None) -> DataFrame:
    """rows without the vector, and ints (binary) or, for wide rows, wide (text): floor(scale * x) of each component, zeros up to width.

    Columns of rows named ints or wide are replaced.
    """
    most = limit or limit_of(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(vector).cast(pa.list_(pa.float64()))
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            matrix = np.zeros((len(size), width))
            matrix[np.arange(width) < size[:, None]] = flat
            with np.errstate(over="ignore"):
                scaled = np.floor(matrix * scale)
            is_wide = (np.abs(scaled) >= most).any(axis=1)
            scaled[is_wide] = 0
            body = scaled.astype("<i4").tobytes()
            step = 4 * width
            ints = [None if w else body[i * step : (i + 1) * step] for i, w in enumerate(is_wide)]
            wide = [",".join(str(whole(x, scale)) for x in matrix[i].tolist()) if w else None for i, w in enumerate(is_wide)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(ints, pa.binary()), pa.array(wide, pa.string())], [*kept, "ints", "wide"])

    rows = rows.drop("ints", "wide")
    kept = [c for c in rows.columns if c != vector]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != vector)
    return rows.mapInArrow(run, f"{schema}, ints binary, wide string")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one length, without nulls, as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def integers(ints: bytes | None, wide: str | None) -> list[int]:
    """The integers of one row."""
    return np.frombuffer(ints, "<i4").tolist() if ints is not None else [int(x) for x in wide.split(",")] if wide else []


def to_float(x: int) -> float:
    """The nearest double; no number where the integer lies beyond the doubles."""
    try:
        return float(x)
    except OverflowError:
        return math.nan
