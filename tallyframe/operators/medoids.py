"""K-medoids under plain distance.

Rows go to their nearest medoid, then every cluster takes the member with the least sum
of distances to its members, until no medoid moves. That member is found without all
pairs: box summaries give planes under the sum, which leave few candidates, then tight
bounds on both sides, which leave fewer. Of those that are still open in a large cluster
finer boxes leave fewer again, and the exact sums of the rest are taken in linear passes
until every other member is proved worse. Only summaries of a bounded number of boxes and
batches of candidates reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.boxes import PAIRS, Summary, box_facts, squared_gaps, summaries
from tallyframe.session import materialise

BATCH = 64  # candidates of a cluster whose sums the first pass takes
MOST_BATCH = 1_024  # and later passes at most
OPEN = 64  # open candidates of a cluster from which on finer boxes are worth a pass
TIE = 1e-12  # sums closer than this, relatively, are equal; the smallest id then wins


def central_members(assigned: DataFrame, names: Sequence[str], best: dict[int, tuple] | None = None, wanted: int = 1) -> dict[int, list[tuple]]:
    """Per cluster the ``wanted`` members with the least sums of distances to all members: (sum, id, place).

    ``assigned`` has __id, the coordinates, __box, __c and, if it is large, __fine.
    ``best`` may give a known member (sum, id, place) of each cluster to start from; then
    rows without an id are no candidates.
    """
    rows = assigned.groupBy("__c", "__box").agg(*box_facts(names)).collect()  # at most a row per box and cluster
    facts = summaries(rows, "__c", names)
    known = {c: [best[c]] if best and c in best else [] for c in facts}
    under = {}
    planes = []
    for c, (summary, boxes) in facts.items():
        values, slopes = summary.planes()
        flat = values - (slopes * summary.means).sum(axis=1)
        planes += [(c, box, float(a), [float(g) for g in slope]) for box, a, slope in zip(boxes, flat, slopes, strict=True)]
        _, high = summary.bounds(summary.means)
        # by Markov's inequality that many members lie within this distance of the mean
        share = np.divide(summary.n, summary.n - wanted, out=np.full(len(high), np.inf), where=summary.n > wanted) if wanted > 1 else 1.0
        reach = np.sqrt(np.where(summary.spreads > 0, summary.spreads * share, np.where(summary.n >= wanted, 0.0, np.inf)))
        under[c] = float((high + reach * summary.n.sum()).min())
        if known[c]:
            under[c] = min(under[c], known[c][0][0])
    spark = assigned.sparkSession
    table = F.broadcast(spark.createDataFrame(planes, "__c int, __box bigint, __a double, __g array<double>"))
    plane = F.col("__a")
    for i, n in enumerate(names):
        plane = plane + F.col("__g")[i] * F.col(n)
    near = assigned.join(table, ["__c", "__box"]).where(plane * (1 - 1e-9) <= _by_cluster(under) * (1 + TIE)).select("__c", "__id", *names)
    near = near.where("__id IS NOT NULL") if best else near
    bounded = _bounded(near, names, {c: s for c, (s, _) in facts.items()}, under, wanted)
    if "__fine" in assigned.columns:
        left = bounded.where(F.col("__low") <= _by_cluster(under) * (1 + TIE))
        if any(r["n"] > OPEN for r in left.groupBy("__c").agg(F.count("*").alias("n")).collect()):
            rows = assigned.groupBy("__c", "__fine").agg(*box_facts(names)).collect()  # as above, of more boxes
            finer = {c: s for c, (s, _) in summaries(rows, "__c", names, "__fine").items()}
            bounded = _bounded(left.select("__c", "__id", *names), names, finer, under, wanted)
    done = {c: [] for c in facts}
    last: dict[int, tuple] = {}  # per cluster the bound and id up to which candidates are done
    size = BATCH
    while True:
        left = bounded.where(F.col("__low") <= _by_cluster(under) * (1 + TIE))
        for c, (low, row_id) in last.items():
            later = F.col("__id").isNotNull() if row_id is None else F.col("__id") > row_id  # NULL comes first
            left = left.where((F.col("__c") != c) | (F.col("__low") > low) | ((F.col("__low") == low) & later))
        order = Window.partitionBy("__c").orderBy("__low", "__id")
        batch = left.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= size).collect()
        if not batch:
            return {c: _least([*known[c], *done[c]], wanted) for c in facts}
        for r in sorted(batch, key=lambda r: r["__r"]):
            last[r["__c"]] = r["__low"], r["__id"]
        held = {m[1] for c in known for m in known[c]}
        for c, found in _exact_sums(assigned, names, [r for r in batch if r["__id"] not in held]).items():
            done[c] += found
            sums = sorted(m[0] for m in [*known[c], *done[c]])
            if len(sums) >= wanted:
                under[c] = min(under[c], sums[wanted - 1])
        size = min(2 * size, MOST_BATCH)


def _by_cluster(values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), F.col("__c"))


def _bounded(near: DataFrame, names: Sequence[str], facts: dict[int, Summary], under: dict[int, float], wanted: int) -> DataFrame:
    """``near`` with bounds of its sums (__low, __high), written; lowers ``under`` to what they prove."""
    given = near.sparkSession.sparkContext.broadcast(facts)
    columns = ["__c", "__id", *names]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("__c").to_numpy()
            x = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            low, high = np.zeros(len(x)), np.zeros(len(x))
            for c in np.unique(cluster).tolist():
                own = cluster == c
                low[own], high[own] = given.value[c].bounds(x[own])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low), pa.array(high)], names=[*columns, "__low", "__high"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in near.schema.fields)
    bounded = materialise(near.mapInArrow(bound, f"{kinds}, `__low` double, `__high` double"))
    least = Window.partitionBy("__c").orderBy("__high")
    tops = bounded.withColumn("__r", F.row_number().over(least)).where(F.col("__r") <= wanted)
    for r in tops.groupBy("__c").agg(F.max("__high").alias("__top"), F.count("*").alias("__n")).collect():
        if r["__n"] == wanted:
            under[r["__c"]] = min(under[r["__c"]], r["__top"])
    return bounded


def _least(members: list[tuple], wanted: int) -> list[tuple]:
    """The members with the least sums; of nearly equal sums the smaller id comes first."""
    left, out = sorted(members, key=lambda m: (m[0], m[1])), []
    while left and len(out) < wanted:
        equal = [m for m in left if m[0] <= left[0][0] * (1 + TIE)]
        out.append(min(equal, key=lambda m: m[1]))
        left.remove(out[-1])
    return out


def _exact_sums(assigned: DataFrame, names: Sequence[str], batch: Sequence) -> dict[int, list[tuple]]:
    """Per cluster (sum of distances to all members, id, place) of the candidates."""
    if not batch:
        return {}
    asked: dict[int, list] = {}
    for r in batch:
        asked.setdefault(r["__c"], []).append((r["__id"], [r[n] for n in names]))
    places = {c: np.array([p for _, p in members]) for c, members in asked.items()}
    given = assigned.sparkSession.sparkContext.broadcast(places)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(len(p)) for c, p in given.value.items()}
        for rows in batches:
            cluster = rows.column("__c").to_numpy()
            x = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
            for c, p in given.value.items():
                members = x[cluster == c]
                step = max(1, PAIRS // len(p))
                for at in range(0, len(members), step):
                    gaps = squared_gaps(members[at : at + step], p)
                    total[c] += np.sqrt(gaps, out=gaps).sum(axis=0)
        flat = [(c, j, float(v)) for c, sums in total.items() for j, v in enumerate(sums.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*flat, strict=True), (pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["c", "j", "s"])

    partial = assigned.select("__c", *names).mapInArrow(add, "c int, j int, s double")
    sums = {(r["c"], r["j"]): r["s"] for r in partial.groupBy("c", "j").agg(F.sum("s").alias("s")).collect()}
    return {c: [(sums[c, j], *member) for j, member in enumerate(members)] for c, members in asked.items()}


def settle(points: DataFrame, names: Sequence[str], medoids: list[tuple], nearest, max_rounds: int) -> list[tuple]:
    """Medoids (id, place) that no member of their clusters improves on.

    ``nearest`` gives the column of the nearest place's number. A medoid stays if no
    member has a smaller sum; a cluster without members keeps its medoid.
    """
    best: dict[int, tuple] = {}
    for _ in range(max_rounds):
        assigned = points.withColumn("__c", nearest([m[1] for m in medoids]).cast("int"))
        held = _exact_sums(assigned, names, [{"__c": c, "__id": m[0], **dict(zip(names, m[1], strict=True))} for c, m in enumerate(medoids)])
        best = {c: found[0] for c, found in held.items()}
        moved = list(medoids)
        for c, (found, *_) in central_members(assigned, names, best).items():
            if found[0] < best[c][0] * (1 - TIE):
                moved[c] = found[1:]
        if moved == medoids:
            return medoids
        medoids = moved
    raise RuntimeError(f"medoids still move after {max_rounds} rounds")


def central_start(points: DataFrame, names: Sequence[str], k: int) -> list[tuple]:
    """The k rows with the least sums of distances to all rows, as (id, place), ties to the smaller id."""
    one = points.withColumn("__c", F.lit(0))
    found = central_members(one, names, wanted=k).get(0, [])
    if len(found) < k:
        raise ValueError(f"fewer than {k} rows")
    return [m[1:] for m in found]


def distance(names: Sequence[str], place: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for n, c in zip(names, place, strict=True):
        total = total + (F.col(n) - F.lit(c)) * (F.col(n) - F.lit(c))
    return F.sqrt(total)
