"""Packing tokenised documents into sequences by dominance reduction and best fit.

Token counts are whole numbers up to the capacity, so an instance of any size is a
histogram with one count per length. The plan is made on the histogram: sets that
provably dominate every alternative are fixed first (Martello and Toth), best fit
decreasing packs what is left. Documents take their places by their rank among the
documents of their length, which is counted task by task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise
from tallyframe.llm.units import unit_encoder

ENCODE_TOGETHER = 256  # texts in one call of the tokenizer
RANK_BITS = 44  # ranks below 2^44 beside lengths below 2^19 in one long


@dataclass
class Plan:
    """Ranks lo..lo+n-1 of a length go to sequences base..base+n-1 at one offset."""

    capacity: int
    sequences: int = 0
    rows: list[tuple[int, int, int, int]] = field(default_factory=list)  # length, lo, base, offset
    used: dict[int, int] = field(default_factory=lambda: defaultdict(int))

    def open(self, n: int) -> int:
        base, self.sequences = self.sequences, self.sequences + n
        return base

    def put(self, length: int, n: int, base: int, offset: int) -> None:
        self.rows.append((length, self.used[length], base, offset))
        self.used[length] += n


def _smallest(left: dict[int, int], n: int) -> list[int]:
    """The n smallest lengths that are left, with repetitions."""
    out: list[int] = []
    for length in sorted(left):
        out += [length] * min(left[length], n - len(out))
        if len(out) == n:
            break
    return out


def _best_pair(lengths: list[int], left: dict[int, int], room: int) -> int:
    """Largest sum of two documents that fit into ``room`` together, 0 without any."""
    best, i, j = 0, 0, len(lengths) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room:
            j -= 1
            continue
        if i != j or left[lengths[i]] > 1:
            best = max(best, total)
        i += 1
    return best


def reduce(left: dict[int, int], plan: Plan) -> None:
    """Fix sets that dominate all others containing their longest document; ``left`` shrinks.

    For a document of length j let k be the longest that fits beside it. {j} alone
    dominates if nothing fits. {j, k} dominates if k fills the room exactly, if no two
    others fit together, or if at most two others fit and no fitting pair is longer
    than k: whatever stood beside j in a solution can then change places with k.
    Passes repeat until one of them fixes nothing.
    """
    fixed = True
    while fixed:
        fixed = False
        for j in sorted(left, reverse=True):
            while left.get(j, 0):
                room = plan.capacity - j
                others = dict(left)
                others[j] -= 1
                lengths = sorted(x for x, n in others.items() if n)
                fitting = [x for x in lengths if x <= room]
                if not fitting:
                    n = left.pop(j)
                    plan.put(j, n, plan.open(n), 0)
                    fixed = True
                    break
                k = fitting[-1]
                if k != room:
                    small = _smallest({x: n for x, n in others.items() if n}, 3)
                    two_fit = len(small) > 1 and small[0] + small[1] <= room
                    three_fit = len(small) > 2 and sum(small) <= room
                    if two_fit and (three_fit or _best_pair(fitting, others, room) > k):
                        break
                n = left[j] // 2 if j == k else min(left[j], left[k])
                base = plan.open(n)
                plan.put(j, n, base, 0)
                plan.put(k, n, base, j)
                for x in (j, k):
                    left[x] -= n
                for x in {j, k}:
                    if not left[x]:
                        del left[x]
                fixed = True


def best_fit(left: dict[int, int], plan: Plan) -> None:
    """Best fit decreasing on counts: alike sequences stay one group until they are filled differently."""
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> groups (base, n)
    for length in sorted(left, reverse=True):
        n = left[length]
        for room in range(length, plan.capacity):
            while n and rooms.get(room):
                base, held = rooms[room].pop()
                n -= _fill(plan, rooms, length, n, base, held, room)
        each = plan.capacity // length
        if n:
            held = -(-n // each)
            _fill(plan, rooms, length, n, plan.open(held), held, plan.capacity)
    left.clear()


def _fill(plan: Plan, rooms: dict, length: int, n: int, base: int, held: int, room: int) -> int:
    """Put up to n documents into the group's sequences, as many as fit into each; how many were put."""
    each = room // length
    full = min(held, n // each)
    some = min(n - full * each, each - 1) if full < held else 0
    for first, sequences, times in ((base, full, each), (base + full, min(1, some), some)):
        if sequences:
            for i in range(times):
                plan.put(length, sequences, first, plan.capacity - room + i * length)
            rooms[room - times * length].append((first, sequences))
    rest = held - full - min(1, some)
    if rest:
        rooms[room].append((base + held - rest, rest))
    return full * each + some


def make_plan(counts: dict[int, int], capacity: int) -> Plan:
    plan, left = Plan(capacity), {k: n for k, n in counts.items() if n}
    reduce(left, plan)
    best_fit(left, plan)
    return plan


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities, and what is over in front."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, part, nth): the pieces, with their number among those of equal length in their task."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = unit_encoder(tokenizer, True), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), defaultdict(int)
        for whole in batches:
            for at in range(0, whole.num_rows, ENCODE_TOGETHER):
                batch = whole.slice(at, ENCODE_TOGETHER)
                texts = [t.as_py() or "" for t in batch.column(1)]
                rows, numbers = [], []
                for row, ids in enumerate(encoder.encode(texts)):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append(row)
                        crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                        numbers.append((piece, start, length, crc, part, seen[length]))
                        seen[length] += 1
                columns = list(zip(*numbers, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(
        tokenise, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"
    )


def pack(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a place for every piece of every row.

    A document is its token ids and ``end_id``; NULL and empty texts are the end alone.
    Longer documents than ``capacity`` are cut, the short piece in front. Repeated rows
    and repeated or NULL ids are packed each by itself; which of several pieces of
    equal length gets which place follows the order of tasks and rows. An empty table
    gives no rows. The pieces are written once, so a lost executor changes no rank;
    the driver sees one count per length, never more than ``capacity`` of them, and
    the plan's size does not depend on the number of documents.
    """
    held = materialise(pieces(docs, id_col, text_col, tokenizer, capacity, end_id))
    per_task = held.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(per_task.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = np.array(sorted(make_plan(counts, capacity).rows), np.int64).reshape(-1, 4)
    keys = (rows[:, 0] << RANK_BITS) + rows[:, 1]

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for length, rank in batches:
            rank = rank.to_numpy(zero_copy_only=False)
            row = np.searchsorted(keys, (length.to_numpy(zero_copy_only=False) << RANK_BITS) + rank, side="right") - 1
            sequence = rows[row, 2] + rank - rows[row, 1]
            yield pa.StructArray.from_arrays([pa.array(sequence), pa.array(rows[row, 3])], ["sequence_id", "offset"])

    ranked = held.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = ranked.withColumn("place", place("length", "rank"))
    return placed.select("id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
