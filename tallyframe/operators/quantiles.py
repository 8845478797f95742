"""Exact percentiles and global ranks that do not funnel into one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer. Here a
percentile is found by selection, at every size. Over whole columns one aggregate gives
counts, extremes and a mergeable sketch, whose values bracket each wanted order
statistic; one aggregate counts the rows below and in the brackets, and one job ranks
the few distinct values inside. A bracket that still holds many rows is sketched again,
and one that misses its rank is widened, so the result never depends on the sketch.

In groups, splitters estimated on a sample cut each column into value buckets, one
counting pass over all rows finds which bucket holds each wanted order statistic, and
only the distinct values of those buckets are ranked, range partition by range
partition. The result is exact however good or bad the splitters are, and a crowded
bucket is spread over as many tasks as it needs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tallyframe.session import materialise

SKETCH = 10_000  # accuracy of the sketch: ranks are off by at most 1 / SKETCH of the rows
MARGIN = 3 / SKETCH  # of the rows, on both sides of a wanted rank
GATHER = 100_000  # rows of a bracket that are ranked in one task; larger brackets are sketched again
ROWS_PER_BUCKET = 5_000
MAX_BUCKETS = 8_192
SPLITTER_ROWS = 25_000  # at least so many rows are looked at to place the splitters
SPLITTER_ROWS_PER_BUCKET = 25


def clean_double(name: str) -> Column:
    """The column as double with NaN read as NULL, as all statistics here do."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Linearly interpolated percentiles as rows (by..., column, probability, value).

    NULL and NaN are ignored; a column without values gives a NULL row for each
    probability overall, and no row in a group. NULL is a group like any other.
    ``rows`` saves the counting job of groups when the size is known. ``df`` is read
    three times: store it first if it is costly to make.
    """
    if not columns:
        raise ValueError("no columns given")
    if by:
        values = df.select(*by, *[clean_double(c).alias(c) for c in columns])
        return _selected_percentiles(values, columns, probabilities, by, values.count() if rows is None else rows)
    found, _ = column_percentiles(df, columns, probabilities)
    return df.sparkSession.createDataFrame([(c, p, v) for (c, p), v in found.items()], "column string, probability double, value double")


def column_percentiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], more: Sequence[Column] = ()
) -> tuple[dict[tuple[str, float], float | None], Row]:
    """{(column, probability): value or None}, and the row of the aggregates ``more`` from the same first pass."""
    names = list(dict.fromkeys(columns))
    asked = [float(p) for p in dict.fromkeys(probabilities)]
    values = df.select("*", *[clean_double(c).alias(f"__v{i}") for i, c in enumerate(names)])
    near = [q for p in asked for q in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    first = [F.struct(F.count(f"__v{i}").alias("n"), F.min(f"__v{i}").alias("low"), F.max(f"__v{i}").alias("high"),
                      F.percentile_approx(f"__v{i}", near, SKETCH).alias("near")).alias(f"__s{i}") for i in range(len(names))]
    facts = values.agg(*first, *more).first()
    wanted: dict[tuple[int, int], Statistic] = {}
    for i in range(len(names)):
        s = facts[f"__s{i}"]
        for j, p in enumerate(asked if s["n"] else []):
            for rank in {math.floor(p * (s["n"] - 1)), math.ceil(p * (s["n"] - 1))}:
                wanted.setdefault((i, rank), Statistic(i, rank, s["low"], s["high"], s["near"][2 * j], s["near"][2 * j + 1]))
    _select(values, list(wanted.values()))
    found = {}
    for i, c in enumerate(names):
        n = facts[f"__s{i}"]["n"]
        for p in asked:
            position = p * (n - 1)
            low, high = (wanted[i, r].value if n else None for r in (math.floor(position), math.ceil(position)))
            found[c, p] = low + (high - low) * (position - math.floor(position)) if n else None
    return found, facts


@dataclass
class Statistic:
    """The value of one rank (from 0) of a column: between least and most for sure, between low and high by the sketch."""

    column: int
    rank: int
    least: float
    most: float
    low: float
    high: float
    skipped: int = 0  # rows before those strictly between low and high
    value: float | None = None

    @property
    def probe(self) -> tuple[int, float, float]:
        return self.column, self.low, self.high

    def between(self) -> Column:
        value = F.col(f"__v{self.column}")
        return (value > self.low) & (value < self.high)


def _select(values: DataFrame, wanted: list[Statistic]) -> None:
    """Find every value: count around the probes, rank what is between if it is little, and sketch it again if not.

    A probe that misses still cuts the sure interval at one of the column's values, and a
    new one lies strictly within the old, so every round leaves fewer values in question.
    """
    while wanted:
        probes = list(dict.fromkeys(s.probe for s in wanted))
        counts = []
        for i, (column, low, high) in enumerate(probes):
            value = F.col(f"__v{column}")
            parts = (value < low, value == low, (value > low) & (value < high), value == high)
            counts.append(F.struct(*[F.count_if(c).alias(f"n{j}") for j, c in enumerate(parts)]).alias(f"__p{i}"))
        counted = dict(zip(probes, values.agg(*counts).first(), strict=True))
        few, many, missed = [], [], []
        for s in wanted:
            below, at_low, inside, at_high = counted[s.probe]
            at_high = 0 if s.low == s.high else at_high
            s.skipped = below + at_low
            if s.rank < below or s.rank >= below + at_low + inside + at_high:
                s.least, s.most = (s.least, s.low) if s.rank < below else (s.high, s.most)
                s.low, s.high = s.least, s.most
                missed.append(s)
            elif s.rank < s.skipped:
                s.value = s.low
            elif s.rank >= s.skipped + inside:
                s.value = s.high
            else:
                s.least, s.most = s.low, s.high
                (few if inside <= GATHER else many).append((s, inside))
        if many:
            sketches = []
            for i, (s, inside) in enumerate(many):
                share = (s.rank - s.skipped) / inside
                near = [max(0.0, share - MARGIN), min(1.0, share + MARGIN)]
                sketches.append(F.percentile_approx(F.when(s.between(), F.col(f"__v{s.column}")), near, SKETCH).alias(f"__s{i}"))
            for (s, _), near in zip(many, values.agg(*sketches).first(), strict=True):
                s.low, s.high = near
        _rank(values, [s for s, _ in few])
        wanted = missed + [s for s, _ in many]


def _rank(values: DataFrame, wanted: list[Statistic]) -> None:
    """Rank the distinct values strictly between the probes, few enough for one task each, and read off the wanted ones."""
    if not wanted:
        return
    probes = {probe: i for i, probe in enumerate(dict.fromkeys(s.probe for s in wanted))}
    first = {s.probe: s for s in wanted}
    entry = lambda probe, i: F.when(first[probe].between(), F.struct(F.lit(i).alias("probe"), F.col(f"__v{probe[0]}").alias("value")))
    inside = F.filter(F.array(*[entry(probe, i) for probe, i in probes.items()]), lambda x: x.isNotNull())
    counted = values.select(F.explode(inside).alias("x")).groupBy("x.probe", "x.value").agg(F.count("*").alias("copies"))
    placed = counted.withColumn("upto", F.sum("copies").over(Window.partitionBy("probe").orderBy("value")))
    hits = [
        (F.col("probe") == probes[s.probe]) & (F.col("upto") > s.rank - s.skipped) & (F.col("upto") - F.col("copies") <= s.rank - s.skipped)
        for s in wanted
    ]
    rows = placed.where(reduce(lambda a, b: a | b, hits)).collect()  # a row for every wanted rank
    for s in wanted:
        place = s.rank - s.skipped
        s.value = next(r["value"] for r in rows if r["probe"] == probes[s.probe] and r["upto"] - r["copies"] <= place < r["upto"])


def percentile_table(
    df: DataFrame, columns: Sequence[str], probabilities: dict[str, float], by: Sequence[str] = (), **options
) -> DataFrame:
    """``percentiles`` with one row per (by..., column) and one named field per probability."""
    long = percentiles(df, columns, list(probabilities.values()), by, **options)
    picks = [
        F.max(F.when(F.col("probability") == F.lit(p), F.col("value"))).alias(name) for name, p in probabilities.items()
    ]
    return long.groupBy(*by, "column").agg(*picks)


def _splitters(values: DataFrame, columns: Sequence[str], buckets: int, total: int) -> dict[str, list[float]]:
    """At most ``buckets`` increasing cut points per column (a bounded collect)."""
    grid = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))
    accuracy = max(10_000, 4 * buckets)
    needed = max(SPLITTER_ROWS, SPLITTER_ROWS_PER_BUCKET * buckets)
    looked_at = values.sample(needed / total, seed=0) if total > needed else values
    cuts = [F.expr(f"percentile_approx(`{c}`, array({grid}), {accuracy})").alias(c) for c in columns]
    row = looked_at.agg(*cuts).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def _selected_percentiles(values, columns, probabilities, by, total):
    by = list(by)
    buckets = max(4, min(MAX_BUCKETS, total // ROWS_PER_BUCKET))
    cuts = _splitters(values, columns, buckets, total)
    bucketed = Bucketizer(
        inputCols=list(columns),
        outputCols=[f"{c}__bucket" for c in columns],
        splitsArray=[[float("-inf"), *(cuts[c] or [0.0]), float("inf")] for c in columns],
        handleInvalid="keep",
    ).transform(values)
    entries = ", ".join(f"'{c}', `{c}`, `{c}__bucket`" for c in columns)
    long = bucketed.selectExpr(
        *[f"`{b}`" for b in by], f"stack({len(columns)}, {entries}) as (`column`, `value`, `bucket`)"
    ).where(F.col("value").isNotNull())
    group = [*by, "column"]

    # At most MAX_BUCKETS rows per group reach these windows.
    sizes = long.groupBy(*group, "bucket").agg(F.count("*").alias("size"))
    running = Window.partitionBy(*group).orderBy("bucket")
    sizes = sizes.select(
        *group,
        "bucket",
        F.sum("size").over(running).alias("end"),
        (F.sum("size").over(running) - F.col("size")).alias("start"),
        F.sum("size").over(Window.partitionBy(*group)).alias("n"),
    )
    asked = F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
    wanted = sizes.select("*", asked.alias("probability")).withColumn("position", F.col("probability") * (F.col("n") - 1))
    ranks = F.array_distinct(F.array(F.floor("position"), F.ceil("position")))
    wanted = materialise(
        wanted.select("*", F.explode(ranks).alias("rank"))
        .where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
        .select(*[F.col(g).alias(f"w_{g}") for g in group], F.col("bucket").alias("w_bucket"), "start", "probability", "position", "rank")
    )

    def same(left):
        keys = [left[g].eqNullSafe(F.col(f"w_{g}")) for g in group]
        return reduce(lambda a, b: a & b, keys, left["bucket"] == F.col("w_bucket"))

    # Only the wanted buckets are shuffled, with equal values collapsed to one row.
    needed = wanted.select(*[f"w_{g}" for g in group], "w_bucket").distinct()
    counted = long.join(needed, same(long), "left_semi").groupBy(*group, "bucket", "value").agg(F.count("*").alias("copies"))
    ranged = counted.repartitionByRange(*group, "bucket", "value").withColumn("range", F.spark_partition_id())
    counted = materialise(ranged)
    cell = [*group, "bucket"]
    earlier = Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.groupBy(*cell, "range").agg(F.sum("copies").alias("size"))  # a row per range and bucket in it
    offsets = offsets.select(
        *[F.col(c).alias(f"o_{c}") for c in [*cell, "range"]], F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("skipped")
    )
    at = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in [*cell, "range"]])
    inside = F.sum("copies").over(Window.partitionBy(*cell, "range").orderBy("value"))
    placed = counted.withColumn("inside", inside).join(offsets, at).drop(*[f"o_{c}" for c in [*cell, "range"]])
    ordered = placed.withColumn("upto", F.col("skipped") + F.col("inside")).withColumn("before", F.col("upto") - F.col("copies"))
    offset = F.col("rank") - F.col("start")
    statistics = ordered.join(wanted, same(ordered)).where((offset >= F.col("before")) & (offset < F.col("upto")))
    low, high = F.min_by("value", "rank"), F.max_by("value", "rank")
    return statistics.groupBy(*group, "probability").agg(
        (low + (high - low) * (F.max("position") - F.floor(F.max("position")))).alias("value")
    )


def global_rank(df: DataFrame, order_by: Sequence[Column], name: str = "rank", partitions: int | None = None) -> DataFrame:
    """1-based rank over all rows, numbered range by range.

    The order must be total (end it with a unique key). Rows are range
    partitioned and written once to the shared folder, so the numbering survives
    the loss of an executor; only one count per partition is ever combined.
    """
    ranged = df.repartitionByRange(partitions, *order_by) if partitions else df.repartitionByRange(*order_by)
    # monotonically_increasing_id is (partition << 33) + position in the partition
    numbered = materialise(ranged.sortWithinPartitions(*order_by).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(F.col("__id"), 33)
    sizes = numbered.groupBy(part.alias("__part")).agg(F.count("*").alias("__size"))
    # one row per partition: a bounded window
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    joined = numbered.join(F.broadcast(starts), part == F.col("__p"))
    return joined.withColumn(
        name, F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(1)
    ).drop("__id", "__p", "__start")


def quartile_of_rank(rank: Column, total: Column) -> Column:
    """Quartile 1-4 of a rank among ``total``, by linear-interpolated rank edges.

    Integer arithmetic: ceil(4 * (rank - 1) / (total - 1)), at least 1.
    """
    raised = (rank - 1) * 4 + total - 2
    return F.greatest(F.lit(1), F.floor(F.try_divide(raised, total - 1))).cast("int")


def quartile_by_value(df: DataFrame, column: str, name: str, descending: bool = False, **options) -> DataFrame:
    """Quartile score by value edges, right-closed, lowest value included.

    ``descending`` gives 4 to the lowest quarter. Equal edges raise ``ValueError``.
    """
    return df.withColumn(name, score_by_edges(F.col(column), quartile_edges(df, [column], **options)[column], descending))


def quartile_edges(df: DataFrame, columns: Sequence[str], **options) -> dict[str, list[float]]:
    """Minimum, quartiles and maximum of every column: five numbers per column on the driver."""
    rows = percentiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], **options).orderBy("probability").collect()
    edges = {c: [r["value"] for r in rows if r["column"] == c] for c in columns}
    for column, found in edges.items():
        if None in found:
            raise ValueError(f"{column} has no values to cut into quartiles")
        if len(set(found)) < len(found):
            raise ValueError(f"quartile edges of {column} are not unique: {found}")
    return edges


def score_by_edges(value: Column, edges: Sequence[float], descending: bool = False) -> Column:
    """1 to 4 by the right-closed quartile holding the value, or 4 to 1."""
    scores = [4, 3, 2, 1] if descending else [1, 2, 3, 4]
    score = F.when(value <= edges[1], scores[0]).when(value <= edges[2], scores[1])
    return score.when(value <= edges[3], scores[2]).when(value.isNotNull(), scores[3])
