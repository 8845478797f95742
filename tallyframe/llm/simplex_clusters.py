"""Centroid clustering of vectors, filtered by n-simplex projection.

The distances of a vector to a few pivots fix the apex of a simplex over the pivots: its
coordinates along the base and its altitude above it. Of two apexes the straight
distance is a lower bound of the true distance, and the distance with one altitude
turned over an upper bound. The distances of the vectors to the pivots are computed
once and the apexes kept in a table; in every round the centroids get apexes too. A
centroid whose lower bound exceeds the least upper bound of a vector is out; if more
than one is left, whole numbers decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise
from tallyframe.llm.vectors import LONGEST, SUMS, WIDE, finite, floors, group_sums, packed, squared, storage, sum_rows, total_sums, unpacked

PIVOTS = 16  # at most
LEAST_ALTITUDE = 0.05  # of a pivot above the pivots before it, as a share of its distance to the first
SLACK = 1e-9  # relative allowance for rounding in squared lengths; pivots are chosen to keep rounding far below
ROWS = 1 << 13  # vectors compared at once


class Base:
    """The simplex of the pivots: the first at the origin, each further one adding a dimension."""

    def __init__(self, candidates: np.ndarray):
        chosen, corners = [0], np.zeros((0, 0))
        for i in range(1, len(candidates)):
            if len(chosen) == PIVOTS:
                break
            gaps = squared(candidates[chosen], candidates[i]).astype(np.float64)
            place, altitude2 = self._apex(gaps[None, :], corners)
            if altitude2[0] > (LEAST_ALTITUDE**2) * gaps[0]:
                row = np.append(place[0], np.sqrt(altitude2[0]))
                corners = np.vstack([np.pad(corners, ((0, 0), (0, 1))), row])
                chosen.append(i)
        self.pivots, self.corners = candidates[chosen], corners

    @staticmethod
    def _apex(gaps: np.ndarray, corners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates along the base and squared altitude, from squared distances to the pivots."""
        if not len(corners):
            return np.zeros((len(gaps), 0)), gaps[:, 0]
        right = (gaps[:, :1] + (corners * corners).sum(axis=1) - gaps[:, 1:]) / 2
        place = np.linalg.solve(corners, right.T).T
        return place, np.maximum(0.0, gaps[:, 0] - (place * place).sum(axis=1))

    def apexes(self, whole: np.ndarray) -> np.ndarray:
        """Rows of (coordinates, squared altitude, squared distance to the first pivot)."""
        gaps = np.stack([squared(whole, p) for p in self.pivots], axis=1).astype(np.float64)
        place, altitude2 = self._apex(gaps, self.corners)
        return np.concatenate([place, altitude2[:, None], gaps[:, :1]], axis=1)


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the objects of two sets of apexes."""
    slack = SLACK * (a[:, -1:] + b[:, -1] + 1.0)
    place_a, place_b = a[:, :-2], b[:, :-2]
    along = (place_a * place_a).sum(axis=1)[:, None] + (place_b * place_b).sum(axis=1) - 2 * place_a @ place_b.T
    low_a, low_b = (np.sqrt(np.maximum(0.0, x[:, -2] - SLACK * (x[:, -1] + 1))) for x in (a, b))
    high_a, high_b = (np.sqrt(x[:, -2] + SLACK * (x[:, -1] + 1)) for x in (a, b))
    apart = np.maximum(0.0, np.maximum(low_a[:, None] - high_b, low_b - high_a[:, None]))
    over = high_a[:, None] + high_b
    return along - slack + apart * apart, along + slack + over * over


def nearest(whole: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centroid_apexes: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of every vector (ties: the smaller), and how many exact comparisons it took."""
    least, most = bounds(apexes, centroid_apexes)
    possible = least <= most.min(axis=1, keepdims=True)
    open_rows = possible.sum(axis=1) > 1
    found = possible.argmax(axis=1)
    rows = np.flatnonzero(open_rows)
    best, compared = None, 0
    for c in range(len(centroids)):
        some = rows[possible[rows, c]]
        if not len(some):
            continue
        compared += len(some)
        apart = squared(whole[some], centroids[c])
        if best is None:
            best = np.full(len(whole), -1, apart.dtype)
        closer = (best[some] < 0) | (apart < best[some])
        best[some[closer]], found[some[closer]] = apart[closer], c
    return found, compared


def exact_nearest(whole: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid by whole numbers of any size."""
    return np.argmin(np.stack([squared(whole, c) for c in centroids], axis=1), axis=1)


def cluster_vectors(
    df: DataFrame, id_col: str, vector_col: str, clusters: int = 16, rounds: int = 3, length: int = 64, scale: int = 64, seed: int = 1
) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster int, distance long) of every kept row, and the final centroids.

    Kept are vectors of exactly ``length`` components, none NULL, NaN or infinite.
    Components become floor(scale * x), exact at any size. Centroids start as the rows
    with the smallest sha256 of ``<seed>:<id>`` (a NULL id counts as the empty text; ties
    by the vector); with fewer rows there are fewer. Ties go to the smaller number and
    clusters without rows keep their centroid. Repeated rows count each by itself. A
    distance beyond a long is given as the largest long. An empty table gives no rows.
    Other columns are left out, whatever their names.
    """
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    source = df.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector"))
    source = source.where((F.size("vector") == length) & finite(F.col("vector")))
    kind, _ = storage(source, "vector", scale)
    written_id = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = source.orderBy(F.sha2(written_id, 256), "vector").limit(clusters).select("vector").collect()
    centroids = floors(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, length, kind)
    id_kind = source.schema["id"].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"id {id_kind}, cluster int, distance bigint"), centroids
    k, base = len(centroids), Base(centroids) if kind != WIDE else None
    shared = spark.sparkContext.broadcast(base)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = floors(batch.column("vector"), scale, length, kind)
            apexes = [b""] * len(whole) if kind == WIDE else [row.tobytes() for row in shared.value.apexes(whole)]
            columns = [batch.column("id"), packed(whole, kind), pa.array(apexes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "vector", "apex"])

    stored = materialise(source.mapInArrow(project, f"id {id_kind}, vector binary, apex binary"))

    def placed(batches: Iterator[pa.RecordBatch], given) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        now, now_apexes = given.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, ROWS):
                batch = whole_batch.slice(at, ROWS)
                whole = unpacked(batch.column("vector"), length, kind)
                if kind == WIDE:
                    yield batch.column("id"), whole, exact_nearest(whole, now)
                else:
                    apexes = np.frombuffer(b"".join(batch.column("apex").to_pylist()), np.float64).reshape(len(whole), -1)
                    yield batch.column("id"), whole, nearest(whole, apexes, now, now_apexes)[0]

    for done in range(rounds + 1):
        given = spark.sparkContext.broadcast((centroids, base.apexes(centroids) if base else None))

        def add(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            total = [np.zeros(k, np.int64), np.zeros((k, length), object if kind == WIDE else np.int64)]
            for _, whole, found in placed(batches, given):
                n, sums = group_sums(whole, found, k)
                total[0] += n
                total[1] += sums
            rows = sum_rows(0, *total)
            if rows:
                types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

        def final(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            for ids, whole, found in placed(batches, given):
                apart = squared(whole, given.value[0][found])
                capped = pa.array([min(int(d), LONGEST) for d in apart.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), capped], names=["id", "cluster", "distance"])

        if done == rounds:
            return materialise(stored.mapInArrow(final, f"id {id_kind}, cluster int, distance bigint")), centroids
        centroids = centroids.copy()
        for (_, entry), (n, total) in total_sums(stored.select("vector", "apex", "id").mapInArrow(add, SUMS)).items():
            centroids[entry] = [x // n for x in total]
    raise AssertionError("the last round returns")


def centroid_digest(centroid: np.ndarray) -> str:
    """sha256 of the components in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
