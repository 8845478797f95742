"""Vector codes by parts, with codebooks refined under Drake and Hamerly's adaptive bounds.

Every part of a vector keeps its b closest codebook entries, an upper bound on the
distance to the first of them, ordered lower bounds for the others and one outer lower
bound for all entries it does not keep. When the entries have moved, the bounds give
way by the moves. As long as the upper bound stays below the lower bound at place z,
the nearest entry is one of the first z; only these are compared, in whole numbers, and
sorted anew. Where no bound holds, all entries are compared. b shrinks to what almost
all parts needed. The state is written after every round and read by the next one, so a
lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise, scratch_path
from tallyframe.llm.vectors import LONGEST, SUMS, WIDE, finite, floors, group_sums, packed, squared, storage, sum_rows, total_sums, unpacked
from tallyframe.session import delete_stage

ENOUGH = 0.999  # share of the parts that must have got by with b entries
COMPARED = 1 << 21  # components compared at once
USED = -1  # part number of the rows that count how many entries were needed


def up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats, never below the exact value."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(-np.inf))


def root(whole: np.ndarray) -> np.ndarray:
    if whole.dtype == object:  # may be beyond any double
        return np.vectorize(lambda x: float(isqrt(x)) if x < 1 << 1000 else np.inf, otypes=[np.float64])(whole)
    return np.sqrt(whole.astype(np.float64))


@dataclass
class Bounds:
    """Per row of one part: b entries, the upper bound of the first, lower bounds of the others, the outer bound last."""

    near: np.ndarray  # rows x b
    upper: np.ndarray
    lower: np.ndarray  # rows x b: place j bounds entry j + 1 and all later ones

    @classmethod
    def unknown(cls, rows: int, b: int) -> Bounds:
        return cls(np.zeros((rows, b), np.uint8), np.full(rows, np.inf, np.float32), np.full((rows, b), -np.inf, np.float32))

    def moved(self, moves: np.ndarray) -> None:
        """Give way to the moves of the entries, then order the lower bounds from behind."""
        self.upper = up(self.upper.astype(np.float64) + moves[self.near[:, 0]])
        give = np.concatenate([moves[self.near[:, 1:]], np.full((len(self.near), 1), moves.max(initial=0.0))], axis=1)
        self.lower = down(self.lower.astype(np.float64) - give)
        self._ordered()

    def _ordered(self) -> None:
        self.lower = np.minimum.accumulate(self.lower[:, ::-1], axis=1)[:, ::-1]

    def shrunk(self, b: int) -> Bounds:
        """Fewer entries: the lower bound at the last place holds for all that are let go."""
        return Bounds(self.near[:, :b], self.upper, self.lower[:, :b])

    def settle(self, values: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Bring the nearest entry (ties: lower index) to the first place; how many entries each row had to consider."""
        k, b = len(book), self.near.shape[1]
        holds = self.upper[:, None] < self.lower
        z = np.where(holds.any(axis=1), holds.argmax(axis=1), b)
        for places in range(1, b + 1):
            rows = np.flatnonzero(z == places)
            full = places == b
            width = k if full else places + 1
            step = max(1, COMPARED // max(1, width * values.shape[1]))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                entries = np.broadcast_to(np.arange(k), (len(some), k)) if full else np.sort(self.near[some, :width].astype(np.int64), axis=1)
                apart = squared(values[some][:, None, :], book[entries])
                order = np.argsort(apart, axis=1, kind="stable")  # entries ascend, so ties stay in their order
                sorted_entries, gaps = np.take_along_axis(entries, order, 1), root(np.take_along_axis(apart, order, 1))
                self.upper[some] = up(gaps[:, 0])
                kept = min(b, width)
                self.near[some, :kept] = sorted_entries[:, :kept]
                self.lower[some, : kept - 1] = down(gaps[:, 1:kept])
                if full:
                    self.lower[some, kept - 1 :] = down(gaps[:, kept : kept + 1]) if k > kept else np.float32(np.inf)
        self._ordered()
        return np.where(z == b, k, z + 1)

    def tobytes(self) -> list[bytes]:
        joined = np.concatenate([self.near, self.upper[:, None].view(np.uint8), np.ascontiguousarray(self.lower).view(np.uint8)], axis=1)
        return [row.tobytes() for row in joined]

    @classmethod
    def frombytes(cls, raw: np.ndarray, b: int) -> Bounds:
        """From one row of bytes each."""
        upper = np.ascontiguousarray(raw[:, b : b + 4]).view(np.float32)[:, 0].copy()
        return cls(raw[:, :b].copy(), upper, np.ascontiguousarray(raw[:, b + 4 :]).view(np.float32).copy())


def code_vectors(
    df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code binary, error long) of every kept row, and the final codebooks, one array per part.

    Kept are vectors without NULL, NaN or infinite components; an empty vector is kept.
    Components become floor(scale * x), exact at any size; vectors shorter than the
    longest, or whose length ``parts`` does not divide, are filled up with zeros. The
    codebooks start as the parts of the ``entries`` rows with the smallest ids (NULL ids
    last, then by the vector); with fewer rows there are fewer entries. Ties go to the
    lower index, unused entries stay. Repeated rows count each by itself. An error
    beyond a long is given as the largest long. An empty table gives no rows and empty
    codebooks. Other columns are left out, whatever their names.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = df.sparkSession
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
    source = source.where(finite(F.col("vector")))
    kind, longest = storage(source, "vector", scale)
    length = -(-longest // parts) * parts
    size = length // parts
    first = source.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = floors(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, length, kind)
    books = [start[:, p * size : (p + 1) * size] for p in range(parts)]
    k = len(start)
    b = min(k, max(2, entries // 4))
    id_kind, label_kind = (source.schema[c].dataType.simpleString() for c in ("id", "label"))
    if not k:
        return spark.createDataFrame([], f"id {id_kind}, label {label_kind}, code binary, error bigint"), books
    written, moves = None, [np.zeros(k) for _ in range(parts)]
    for done in range(rounds + 1):
        given = spark.sparkContext.broadcast((books, moves, b))
        last = done == rounds

        def placed(batch: pa.RecordBatch, given=given, fresh=written is None):
            """Values by part and settled bounds of a batch."""
            now, gone, width = given.value
            if fresh:
                whole = floors(batch.column("vector"), scale, length, kind)
            else:
                whole = unpacked(batch.column("vector"), length, kind)
                raw = np.frombuffer(b"".join(batch.column("state").to_pylist()), np.uint8).reshape(len(whole), parts, -1)
                held = (raw.shape[2] - 4) // 5
            found, used = [], np.zeros(k + 1, np.int64)
            for p in range(parts):
                values = whole[:, p * size : (p + 1) * size]
                bounds = Bounds.unknown(len(whole), width)
                if not fresh and kind != WIDE:
                    bounds = Bounds.frombytes(raw[:, p], held).shrunk(width)
                    bounds.moved(gone[p])
                used += np.bincount(bounds.settle(values, now[p]), minlength=k + 1)
                found.append((values, bounds))
            return whole, found, used

        names = ["kind", "id", "label", "vector", "state", "part", "entry", "n", "sums"]

        def round_of(batches: Iterator[pa.RecordBatch], placed=placed) -> Iterator[pa.RecordBatch]:
            totals = [[np.zeros(k, np.int64), np.zeros((k, size), object if kind == WIDE else np.int64)] for _ in range(parts)]
            needed = np.zeros(k + 1, np.int64)
            for batch in batches:
                whole, found, used = placed(batch)
                needed += used
                for total, (values, bounds) in zip(totals, found, strict=True):
                    n, sums = group_sums(values, bounds.near[:, 0].astype(np.int64), k)
                    total[0] += n
                    total[1] += sums
                state = [b"".join(row) for row in zip(*[bounds.tobytes() for _, bounds in found], strict=True)]
                rows = len(whole)
                none = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))]
                columns = [pa.array(np.zeros(rows, np.int32)), batch.column("id"), batch.column("label"), packed(whole, kind), pa.array(state, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *none], names=names)
                id_type, label_type = batch.column("id").type, batch.column("label").type
            if not needed.any():
                return
            rows = [r for p, (n, sums) in enumerate(totals) for r in sum_rows(p, n, sums)]
            rows += [(USED, int(z), int(needed[z]), []) for z in np.flatnonzero(needed)]
            none = [pa.nulls(len(rows), t) for t in (id_type, label_type, pa.binary(), pa.binary())]
            types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(rows), np.int32)), *none, *columns], names=names)

        def final(batches: Iterator[pa.RecordBatch], placed=placed, given=given) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, found, _ = placed(batch)
                codes = np.stack([bounds.near[:, 0] for _, bounds in found], axis=1)
                error = sum(squared(values, book[bounds.near[:, 0]]) for book, (values, bounds) in zip(given.value[0], found, strict=True))
                capped = [min(int(e), LONGEST) for e in error.tolist()]
                columns = [batch.column("id"), batch.column("label"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(capped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

        rows = source if written is None else spark.read.schema(schema).parquet(written).where("kind = 0").select("id", "label", "vector", "state")
        if last:
            coded = materialise(rows.mapInArrow(final, f"id {id_kind}, label {label_kind}, code binary, error bigint"))
            if written:
                delete_stage(spark, written)
            return coded, books
        schema = f"id {id_kind}, label {label_kind}, vector binary, state binary, {SUMS}, kind int"
        path = scratch_path(spark, "codes")
        rows.mapInArrow(round_of, f"kind int, id {id_kind}, label {label_kind}, vector binary, state binary, {SUMS}").write.partitionBy("kind").parquet(path)
        if written:
            delete_stage(spark, written)
        written = path
        sums = total_sums(spark.read.schema(schema).parquet(path).where("kind = 1").select("part", "entry", "n", "sums"))
        before, books = books, [book.copy() for book in books]
        for (part, entry), (n, total) in sums.items():
            if part != USED:
                books[part][entry] = [x // n for x in total]
        moves = [up(root(squared(new, old))).astype(np.float64) if kind != WIDE else np.zeros(k) for new, old in zip(books, before, strict=True)]
        b = _next_width(b, k, entries, {entry: n for (part, entry), (n, _) in sums.items() if part == USED})
    raise AssertionError("the last round returns")


def _next_width(b: int, k: int, entries: int, needed: dict[int, int]) -> int:
    """The fewest entries that would have done for almost all parts, at least an eighth of all and never more than now."""
    total, done = sum(needed.values()), 0
    for width in range(1, b + 1):
        done += needed.get(width, 0)
        if done >= ENOUGH * total:
            return max(width, min(b, k, max(2, entries // 8)))
    return b


def codebook_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for book in books for row in book.tolist() for x in row).encode()).hexdigest()
