"""Boxes of neighbouring rows: cuts placed by a sample, and exact facts that summaries of boxes prove."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOXES = 1_024  # boxes of a clustering: their summaries go to the driver and back to every task
FINE_BOXES = 16_384  # of a large one, for the few rows that the others leave open
PAIRS = 1 << 15  # pairs of rows whose gaps are taken at once: small enough for a cache
SAMPLE_PER_BOX = 16  # rows that place the cuts; results never depend on them


class Cuts:
    """A k-d tree over a sample: at every node the widest column is cut at its median.

    ``low`` and ``high`` are the true limits of the box. Where all sampled rows are equal,
    the first cut parts them from the others, so a tree always parts its box.
    """

    def __init__(self, sample: np.ndarray, leaves: int, low: np.ndarray, high: np.ndarray):
        self.nodes: list[tuple] = []  # (column, cut, left, right); column -1 marks a leaf
        if len(sample):
            self._grow(sample, leaves)
        if len(self.nodes) < 2:
            column = int((high - low).argmax())
            cut = float(sample[0, column]) if len(sample) else float(low[column])
            self.nodes = [(column, cut if cut < high[column] else float(np.nextafter(cut, -np.inf)), 1, 2), *[(-1, 0.0, 0, 0)] * 2]
        self.columns = [np.array(c) for c in zip(*self.nodes, strict=True)]

    def _grow(self, rows: np.ndarray, leaves: int) -> int:
        at = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0))
        low, high = rows.min(axis=0), rows.max(axis=0)
        column = int((high - low).argmax())
        if leaves > 1 and high[column] > low[column]:
            middle = float(np.median(rows[:, column]))
            cut = middle if middle < high[column] else float((low[column] + high[column]) / 2)
            below = rows[:, column] <= cut
            left = self._grow(rows[below], leaves // 2)
            self.nodes[at] = (column, cut, left, self._grow(rows[~below], leaves - leaves // 2))
        return at

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        """Number of the leaf that holds each row."""
        column, cut, left, right = self.columns
        at = np.zeros(len(rows), np.int64)
        while (inner := column[at] >= 0).any():
            some = np.flatnonzero(inner)
            node = at[some]
            at[some] = np.where(rows[some, column[node]] <= cut[node], left[node], right[node])
        return at


def with_boxes(points: DataFrame, names: Sequence[str], rows: int, boxes: int = BOXES, name: str = "__box") -> DataFrame:
    """``points`` with the number of a k-d box over ``names``, placed by a sample of bounded size."""
    share = SAMPLE_PER_BOX * boxes / max(rows, 1)
    sample = points.select(*names).sample(share, seed=0) if share < 1 else points.select(*names)
    values = sample.toPandas().to_numpy(float)
    low, high = (values.min(axis=0), values.max(axis=0)) if len(values) else (np.zeros(len(names)), np.zeros(len(names)))
    wanted = max(1, min(boxes, rows // SAMPLE_PER_BOX))
    given = points.sparkSession.sparkContext.broadcast(Cuts(values, wanted, low, high))

    @F.arrow_udf("bigint")
    def box(*columns: pa.Array) -> pa.Array:
        return pa.array(given.value.leaf(np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))

    return points.withColumn(name, box(*names))


def squared_gaps(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``x`` to every place, column by column."""
    total = np.zeros((len(x), len(places)))
    for i in range(x.shape[1]):
        gap = x[:, i, None] - places[:, i]
        gap *= gap
        total += gap
    return total


class Summary:
    """Boxes of a group of points: their numbers, means and mean squared spreads.

    Distance is a convex function and the root a concave one, so by Jensen's inequality
    the distances from x to the n members of a box add up to at least n |x - mean| and at
    most n sqrt(|x - mean|^2 + spread).
    """

    def __init__(self, n: np.ndarray, means: np.ndarray, spreads: np.ndarray):
        self.n, self.means, self.spreads = n, means, np.maximum(spreads, 0.0)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the summed distances from every row of ``x`` to all members."""
        low, high = np.zeros(len(x)), np.zeros(len(x))
        step = max(1, PAIRS // max(1, len(self.means)))
        for at in range(0, len(x), step):
            gap2 = squared_gaps(x[at : at + step], self.means)
            low[at : at + step] = np.sqrt(gap2) @ self.n
            high[at : at + step] = np.sqrt(gap2 + self.spreads) @ self.n
        return low * (1 - 1e-12), high * (1 + 1e-12)

    def planes(self) -> tuple[np.ndarray, np.ndarray]:
        """Value and slope at every mean of the convex lower bound: a plane under the summed distance everywhere."""
        values, slopes = np.zeros(len(self.n)), np.zeros(self.means.shape)
        step = max(1, (1 << 22) // max(1, self.means.size))
        for at in range(0, len(self.n), step):
            apart = self.means[at : at + step, None, :] - self.means
            gap = np.sqrt((apart * apart).sum(axis=2))
            values[at : at + step] = gap @ self.n
            weight = np.divide(self.n, gap, out=np.zeros_like(gap), where=gap > 0)
            slopes[at : at + step] = np.einsum("ij,ijk->ik", weight, apart)
        return values, slopes


def summaries(grouped: Sequence, group: str, names: Sequence[str], box: str = "__box") -> dict:
    """Per group its ``Summary`` and the numbers of its boxes, from collected rows with n, sums and sums of squares."""
    out = {}
    for g in sorted({r[group] for r in grouped}):
        rows = [r for r in grouped if r[group] == g]
        n = np.array([r["__n"] for r in rows], float)
        sums = np.array([[r[f"{c}__sum"] for c in names] for r in rows])
        squares = np.array([r["__squares"] for r in rows])
        means = sums / n[:, None]
        # a little more spread than rounding can take away keeps the upper bound right
        spreads = squares / n - (means * means).sum(axis=1) + 1e-12 * (squares / n)
        out[g] = Summary(n, means, spreads), [r[box] for r in rows]
    return out


def box_facts(names: Sequence[str]) -> list:
    """The aggregates that ``summaries`` reads."""
    squares = sum((F.col(c) * F.col(c) for c in names), F.lit(0.0))
    return [F.count("*").alias("__n"), F.sum(squares).alias("__squares"), *[F.sum(c).alias(f"{c}__sum") for c in names]]
