"""Embedding vectors as exact whole numbers, and exact sums of them over tasks."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NARROW = {"<i2": 1 << 15, "<i4": 1 << 24}  # storage type of components, and what they stay below
WIDE = "wide"  # larger components: decimal text in storage, Python integers in memory
LONGEST = (1 << 63) - 1  # larger results are given as this


def finite(vector: Column) -> Column:
    """Whether the vector is there and holds neither NULL nor NaN nor infinite components."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & inside


def storage(rows: DataFrame, vector: str, scale: int) -> tuple[str, int]:
    """The storage type that holds all scaled components of the table, and the longest vector: one row to the driver."""
    largest = F.max(F.array_max(F.transform(vector, F.abs)))
    found = rows.agg(largest.alias("largest"), F.max(F.size(vector)).alias("length")).first()
    reach = float(found["largest"] or 0) * scale + 1
    kind = next((k for k, limit in NARROW.items() if reach < limit), WIDE)
    return kind, int(found["length"] or 0)


def floors(vectors: pa.Array, scale: int, length: int, kind: str) -> np.ndarray:
    """floor(scale * x) of every component, rows by ``length``; shorter vectors are filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), length), object if kind == WIDE else np.int64)
    inside = np.arange(length) < sizes[:, None]
    # scales are powers of two, so scaling is exact
    out[inside] = [int(Fraction(x) * scale // 1) for x in values.tolist()] if kind == WIDE else np.floor(values * scale).astype(np.int64)
    return out


def packed(whole: np.ndarray, kind: str) -> pa.Array:
    """One binary value per row."""
    if kind == WIDE:
        return pa.array([",".join(map(str, row)).encode() for row in whole.tolist()], pa.binary())
    return pa.array([row.tobytes() for row in whole.astype(kind)], pa.binary())


def unpacked(stored: pa.Array, length: int, kind: str) -> np.ndarray:
    if kind == WIDE:
        rows = [[int(x) for x in row.as_py().split(b",") if x] for row in stored]
        return np.array(rows, object).reshape(len(rows), length)
    return np.frombuffer(b"".join(stored.to_pylist()), kind).reshape(len(stored), length).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    apart = a - b
    return (apart * apart).sum(axis=-1)


def group_sums(whole: np.ndarray, group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, componentwise sums) of every group within one batch, exact."""
    n = np.bincount(group, minlength=groups)
    if whole.dtype == object:
        sums = np.zeros((groups, whole.shape[1]), object)
        np.add.at(sums, group, whole)
        return n, sums
    # components stay below 2^24 and batches below 2^29 rows: doubles add them exactly
    sums = [np.bincount(group, weights=column, minlength=groups) for column in whole.T]
    return n, np.stack(sums, axis=1).astype(np.int64) if sums else np.zeros((groups, 0), np.int64)


SUMS = "part int, entry int, n bigint, sums array<string>"


def sum_rows(part: int, n: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """Rows of ``SUMS`` for the groups that have members."""
    return [(part, int(e), int(n[e]), [str(x) for x in sums[e].tolist()]) for e in np.flatnonzero(n)]


def total_sums(partial: DataFrame) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Sums over all tasks by (part, entry), which are few; Python integers never overflow."""

    def add(table: pa.Table) -> pa.Table:
        part, entry = table["part"][0], table["entry"][0]
        sums = [str(sum(map(int, column))) for column in zip(*table["sums"].to_pylist(), strict=True)]
        n = sum(table["n"].to_pylist())
        return pa.table(
            {"part": pa.array([part.as_py()], pa.int32()), "entry": pa.array([entry.as_py()], pa.int32()),
             "n": pa.array([n], pa.int64()), "sums": pa.array([sums], pa.list_(pa.string()))}
        )

    rows = partial.groupBy("part", "entry").applyInArrow(add, SUMS).collect()
    return {(r["part"], r["entry"]): (r["n"], [int(x) for x in r["sums"]]) for r in rows}
