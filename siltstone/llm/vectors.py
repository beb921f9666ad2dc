"""Vectors as rows of integers: quantised components in numpy's bytes, for operators that multiply or slice them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Quantised components are held to this, so that they and their differences fit 64 bits.
MOST = 1 << 62


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float, label_col: str | None = None) -> DataFrame:
    """(vec_id long, label long, dims int, vector binary): each component becomes floor(scale * x), x as double, as little-endian 64-bit
    integers; rows that are equal in all of these are one row.

    Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components, are left out; so are those of a null
    label if label_col is given (else label is null).
    """
    v = F.col("v")
    label = F.lit(None) if label_col is None else F.col(label_col)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0)))))
    if label_col is not None:
        rows = rows.filter(F.col("label").isNotNull())

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            q = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)), -MOST, MOST).astype("<i8")
            raw = [q[x:y].tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(ends).astype(np.int32)), pa.array(raw, pa.binary())], ["vec_id", "label", "dims", "vector"])

    return rows.mapInArrow(whole, "vec_id long, label long, dims int, vector binary").distinct()


def matrix(column: pa.ChunkedArray | list[bytes], dims: int) -> np.ndarray:
    """Vectors of `dims` 64-bit integers, as rows."""
    values = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(values), "<i8").reshape(-1, dims)


def narrow(x: np.ndarray) -> tuple[str, bytes]:
    """(type, bytes) of integers in the narrowest type that holds them."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return kind, x.astype(kind).tobytes()


def first(n: int, row: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the first n of each row by `order`."""
    at = np.lexsort((*order[::-1], row))
    begin = np.concatenate([[True], row[at][1:] != row[at][:-1]]) if len(at) else np.zeros(0, bool)
    return at[np.arange(len(at)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] < n]


def highest(score: np.ndarray, may: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n highest scores of each row among those that may, ties to the smaller id."""
    low = np.iinfo(score.dtype).min
    held, k = np.where(may, score, low), min(n, score.shape[1])
    border = np.partition(held, -k, axis=1)[:, -k]
    row, at = np.nonzero(may & (score >= border[:, None]))
    some = first(n, row, ~score[row, at], ids[at])  # ~x falls as x rises, and can't overflow
    return row[some], at[some]
