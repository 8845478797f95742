"""Search inside boxes, in tasks: the nearest suggestions and the farthest row of every request that looks into a box.

Rows come sorted by place: first the rows of a box by suggestion and nutrients, then the
requests that look into it by the keys they ask for. Rows that carry these keys are cut
into cells of neighbouring rows, and a request only scores the cells that its bounds
leave open. What leaves the task is at most ``top_n`` suggestions and one distance for
each request.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tallyframe.operators.boxes import PAIRS, Cuts

ROWS_PER_CELL = 64
SLACK = 1e-9  # of a squared distance, for rounding in the bounds
LIMIT = 1e300  # places cuts among infinite values; results never depend on them


class Cells:
    """The rows of a box that carry the asked keys, cell by cell, with the limits of each cell."""

    def __init__(self, values: np.ndarray, rows: np.ndarray, cell: np.ndarray):
        self.rows = rows[np.argsort(cell[rows], kind="stable")]
        own = cell[self.rows]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
        self.sizes = np.diff(np.append(starts, len(own)))
        self.cell = np.repeat(np.arange(len(starts)), self.sizes)
        held = values[:, self.rows]
        self.low, self.high = (f.reduceat(held, starts, axis=1) if len(starts) else held for f in (np.minimum, np.maximum))

    def bounds(self, targets: np.ndarray, factors: np.ndarray, farthest: bool) -> np.ndarray:
        """Per request and cell a bound of the squared distances: from below, or from above for the farthest rows."""
        total = np.zeros((len(targets), len(self.sizes)))
        for i in range(targets.shape[1]):
            low, high = self.low[i] - targets[:, i, None], self.high[i] - targets[:, i, None]
            gap = np.maximum(-low, high) if farthest else np.maximum(np.maximum(low, -high), 0.0)
            gap *= gap
            gap *= factors[:, i, None]
            total += gap
        return total * (1 + SLACK if farthest else 1 - SLACK)


class Box:
    """The rows of one place. Their order is that of suggestion and nutrients, so a smaller row number wins a tie."""

    def __init__(self, pieces: Sequence[pa.RecordBatch], nutrients: Sequence[str], weights: np.ndarray, top_n: int):
        rows = pa.Table.from_batches(pieces).combine_chunks()
        self.nutrients, self.weights, self.top_n = list(nutrients), weights, top_n
        self.values = np.stack([rows.column(n).to_numpy() for n in nutrients])
        self.suggestion = pa.concat_arrays(rows.column("suggestion").chunks)
        self.text = self.suggestion.dictionary_encode().indices.to_numpy()
        self.keys = [self._coded(pa.concat_arrays(rows.column(c).chunks)) for c in ("label_keys", "diet_keys")]
        self.cell: np.ndarray | None = None
        self.held: tuple = (None, None)

    @staticmethod
    def _coded(lists: pa.ListArray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Number of each key, the numbers in all lists, and the row of each."""
        flat = lists.flatten().dictionary_encode()
        lengths = lists.value_lengths().to_numpy()
        return {k: i for i, k in enumerate(flat.dictionary.to_pylist())}, flat.indices.to_numpy(), np.repeat(np.arange(len(lists)), lengths)

    def cells(self, asked: tuple[str, str], targets: np.ndarray) -> Cells:
        if self.cell is None:
            self.cell = self._cut(targets)
        if self.held[0] != asked:
            carries = np.ones(self.values.shape[1], bool)
            for key, (numbers, codes, row) in zip(asked, self.keys, strict=True):
                has = np.zeros(len(carries), bool)
                has[row[codes == numbers.get(key, -1)]] = True
                carries &= has
            self.held = asked, Cells(self.values, np.flatnonzero(carries), self.cell)
        return self.held[1]

    def _cut(self, targets: np.ndarray) -> np.ndarray:
        """The cell of each row, cut along what weighs most for the requests that come first."""
        typical = np.abs(targets).mean(axis=0)
        scale = np.sqrt(self.weights) / np.where((typical > 0) & (typical < LIMIT), typical, 1.0)
        places = np.clip((self.values * scale[:, None]).T, -LIMIT, LIMIT)
        leaves = len(places) // ROWS_PER_CELL
        if leaves < 2:
            return np.zeros(len(places), np.int64)
        return Cuts(places, leaves, places.min(axis=0), places.max(axis=0)).leaf(places)

    def distances(self, rows: np.ndarray, target: np.ndarray, base: np.ndarray) -> np.ndarray:
        relative = self.values[:, rows]
        relative -= target[:, None]
        relative /= base[:, None]
        relative *= relative
        relative *= self.weights[:, None]
        return np.sqrt(sum(relative[1:], relative[0]))  # summed in the order of the nutrients

    def _best(self, rows: np.ndarray, distance: np.ndarray) -> np.ndarray:
        """Places of the best row of each of the ``top_n`` nearest suggestions, nearest first."""
        many = 4 * self.top_n
        while True:
            some = np.flatnonzero(~(distance > np.partition(distance, many)[many])) if many < len(rows) else np.arange(len(rows))
            some = some[np.lexsort((rows[some], distance[some]))]
            first = np.unique(self.text[rows[some]], return_index=True)[1]
            if len(first) >= self.top_n or len(some) == len(rows):
                return some[np.sort(first)[: self.top_n]]
            many *= 4

    def _nearest(self, cells: Cells, bounds: np.ndarray, target: np.ndarray, base: np.ndarray, last: float) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the nearest suggestions no farther than ``last``; NaN where nothing is known of it."""
        if np.isnan(last):
            order = np.argsort(bounds)
            enough = np.searchsorted(np.cumsum(cells.sizes[order]), 4 * self.top_n) + 1
            rows = cells.rows[np.isin(cells.cell, order[:enough])]
            distance = self.distances(rows, target, base)
            best = self._best(rows, distance)
            if len(best) == self.top_n:
                last = distance[best[-1]]
        rows = cells.rows[~(bounds > last * last)[cells.cell]]
        distance = self.distances(rows, target, base)
        near = ~(distance > last)
        rows, distance = rows[near], distance[near]
        best = self._best(rows, distance)
        return rows[best], distance[best]

    def _farthest(self, cells: Cells, bounds: np.ndarray, target: np.ndarray, base: np.ndarray, reached: float) -> float:
        """The largest distance; any that is smaller if none is as large as ``reached``."""
        if np.isnan(reached):
            reached = self.distances(cells.rows[cells.cell == bounds.argmax()], target, base).max()
        rows = cells.rows[~(bounds < reached * reached)[cells.cell]]
        return float(self.distances(rows, target, base).max(initial=0.0))

    def answers(self, requests: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        asked = list(zip(*(requests.column(c).to_pylist() for c in ("label_key", "diet_key")), strict=True))
        targets = np.stack([requests.column(n).to_numpy(zero_copy_only=False) for n in self.nutrients], axis=1)
        base = np.where(targets == 0, 1.0, targets)
        factors = self.weights / np.where(targets == 0, 1.0, targets * targets)
        last, reached = (requests.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("last", "reached"))
        is_near, is_far = (requests.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_near", "is_far"))
        near: list[tuple[int, np.ndarray, np.ndarray]] = []
        far: list[tuple[int, float]] = []
        edges = [i for i in range(1, len(asked)) if asked[i] != asked[i - 1]]
        for a, b in pairwise([0, *edges, len(asked)]):
            cells = self.cells(asked[a], targets)
            if not len(cells.rows):
                continue
            step = max(1, PAIRS // len(cells.sizes))
            for wanted, farthest in ((is_near, False), (is_far, True)):
                own = a + np.flatnonzero(wanted[a:b])
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    bounds = cells.bounds(targets[some], factors[some], farthest)
                    for i, row in zip(some.tolist(), bounds, strict=True):
                        if farthest:
                            far.append((i, self._farthest(cells, row, targets[i], base[i], reached[i])))
                        else:
                            near.append((i, *self._nearest(cells, row, targets[i], base[i], last[i])))
        who = np.repeat([i for i, _, _ in near], [len(r) for _, r, _ in near]).astype(np.int64)
        rows = np.concatenate([np.empty(0, np.int64), *[r for _, r, _ in near]])
        distance = np.concatenate([np.empty(0), *[d for _, _, d in near]])
        numbers = [self.values[i, rows] for i in range(len(self.nutrients))]
        yield self._batch(requests, who, self.suggestion.take(pa.array(rows)), distance, numbers, None)
        none = [pa.nulls(len(far), pa.float64())] * len(self.nutrients)
        yield self._batch(requests, np.array([i for i, _ in far], np.int64), pa.nulls(len(far), pa.string()), None, none, [d for _, d in far])

    def _batch(self, requests, who, suggestion, distance, numbers, far) -> pa.RecordBatch:
        who = pa.array(who)
        ends = [pa.nulls(len(who), pa.float64()) if c is None else pa.array(c, pa.float64()) for c in (distance, far)]
        columns = [requests.column("profile_id").take(who), requests.column("slot").take(who), suggestion.cast(pa.string()), ends[0]]
        names = ["profile_id", "slot", "suggestion", "distance", *self.nutrients, "far"]
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers), ends[1]], names=names)


def answers(batches: Iterator[pa.RecordBatch], nutrients: Sequence[str], weights: np.ndarray, top_n: int) -> Iterator[pa.RecordBatch]:
    """The answers of all places whose rows and requests come sorted in ``batches``; one box is held at a time."""
    at, pieces, box = None, [], None
    for batch in batches:
        place, kind = (batch.column(c).to_numpy() for c in ("place", "kind"))
        edges = np.flatnonzero((place[1:] != place[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in pairwise([0, *edges.tolist(), len(place)]):
            if a == b:
                continue
            if place[a] != at:
                at, pieces, box = place[a], [], None
            piece = batch.slice(a, b - a)
            if kind[a] == 0:
                pieces.append(piece)
                continue
            if box is None and pieces:
                box, pieces = Box(pieces, nutrients, weights, top_n), []
            if box is not None:
                yield from box.answers(piece)
