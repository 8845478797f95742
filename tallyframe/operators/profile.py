"""Column profiles, distributions, outlier fences and feature preparation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import numbers, text
from tallyframe.operators.quantiles import clean_double, column_percentiles, percentile_table
from tallyframe.session import materialise

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
MAX_LABELS = 1_000
MOMENTS = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double"}


def _stack(df: DataFrame, columns: Sequence[str], fields: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows (keep..., column, fields...) from columns named ``<column>__<field>``."""
    entries = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{f}`" for f in fields) for c in columns)
    names = ", ".join(["`column`", *[f"`{f}`" for f in fields]])
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(columns)}, {entries}) as ({names})")


def describe(df: DataFrame, columns: Sequence[str], probabilities: dict[str, float] | None = None) -> DataFrame:
    """One row per column: count, mean, std, min, the asked percentiles, max."""
    probabilities = probabilities or QUARTILES
    moments = []
    for c in columns:
        v = clean_double(c)
        fields = zip(MOMENTS, (F.count(v), F.avg(v), F.stddev_samp(v), F.min(v), F.max(v)), strict=True)
        moments.append(F.struct(*[e.alias(f) for f, e in fields]).alias(f"{c}__moments"))
    found, facts = column_percentiles(df, columns, list(probabilities.values()), moments)
    rows = []
    for c in columns:
        n, mean, std, low, high = facts[f"{c}__moments"]
        rows.append((c, n, mean, std, low, *[found[c, float(p)] for p in probabilities.values()], high))
    kinds = [("column", "string"), *list(MOMENTS.items())[:4], *[(p, "double") for p in probabilities], ("max", "double")]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in kinds))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, row, null, non-null and distinct count of every column (NaN counts as null)."""
    columns = list(columns or df.columns)
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggregates = [F.count("*").alias("n_rows")]
    types = {}
    for field in df.schema.fields:
        if field.name not in columns:
            continue
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value), value)
        types[field.name] = field.dataType.simpleString()
        aggregates += [F.count(value).alias(f"{field.name}__non_null"), distinct(value).alias(f"{field.name}__n_distinct")]
    counted = _stack(df.agg(*aggregates), columns, ["non_null", "n_distinct"], keep=["n_rows"])
    dtype = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return counted.select(
        "column",
        F.element_at(dtype, F.col("column")).alias("dtype"),
        "n_rows",
        (F.col("n_rows") - F.col("non_null")).alias("n_null"),
        "non_null",
        "n_distinct",
    )


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def iqr_fences(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **options) -> DataFrame:
    """Quartiles and the fences 1.5 interquartile ranges outside them, per column (and group)."""
    table = percentile_table(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, **options)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return table.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})


def cap_outliers(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """Clip each column to its own fences. One small row per column is read to the driver."""
    fences = {r["column"]: r for r in iqr_fences(df, columns, **options).collect()}
    capped = {}
    for c in columns:
        low, high = fences[c]["low"], fences[c]["high"]
        if low is not None:
            capped[c] = numbers.clip(F.col(c).cast("double"), F.lit(low), F.lit(high))
    return df.withColumns(capped) if capped else df


def explode_labels(df: DataFrame, column: str, separator: str = ", ") -> DataFrame:
    """One row per label of a delimiter-encoded list; a NULL list keeps its row."""
    return df.withColumn(column, F.explode_outer(text.split_labels(F.col(column), separator)))


def label_vocabulary(df: DataFrame, column: str) -> list[str]:
    """Distinct labels, refused beyond ``MAX_LABELS`` because each becomes a column."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{column} has more than {MAX_LABELS} labels; pass the vocabulary")
    return sorted(r[0] for r in rows)


def add_indicators(df: DataFrame, column: str, vocabulary: Sequence[str] | None = None, multi_hot: bool = False, separator: str = ", ") -> DataFrame:
    """A 0/1 column per label: equality on exploded rows, or membership with ``multi_hot``."""
    if vocabulary is None:
        vocabulary = label_vocabulary(explode_labels(df, column, separator) if multi_hot else df, column)
    if multi_hot:
        labels = text.split_labels(F.col(column), separator)
        flag = lambda v: F.coalesce(F.array_contains(labels, v), F.lit(False)).cast("int")
    else:
        flag = lambda v: F.coalesce(F.col(column) == v, F.lit(False)).cast("int")
    return df.withColumns({v: flag(v) for v in vocabulary})


def prepare_features(df: DataFrame, label: str, continuous: Sequence[str], skewed: Sequence[str], vocabulary: Sequence[str] | None = None, **options) -> DataFrame:
    """Explode labels, add indicators, cap outliers on the exploded rows, then log1p the skewed columns."""
    exploded = materialise(explode_labels(df, label))  # read by the fences and by the result
    flagged = add_indicators(exploded, label, vocabulary)
    capped = cap_outliers(flagged, continuous, **options)
    return capped.withColumns({c: F.log1p(c) for c in skewed})


def auto_bin_count(n: int, low: float, high: float, iqr: float) -> int:
    """Bin count by the wider-data rule: the larger of the Sturges and Freedman-Diaconis counts."""
    if n == 0 or high <= low:
        return 1
    sturges = math.ceil(math.log2(n) + 1)
    width = 2 * iqr / n ** (1 / 3)
    return max(sturges, math.ceil((high - low) / width)) if width > 0 else sturges


def markers(df: DataFrame, columns: Sequence[str], **options) -> DataFrame:
    """(column, mean, median, q1, q3): the lines drawn into a histogram."""
    described = describe(df, columns, {"q1": 0.25, "median": 0.5, "q3": 0.75}, **options)
    return described.select("column", "mean", "median", "q1", "q3")


def histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins count 0.

    Without ``bins`` their number follows from the data, see ``auto_bin_count``.
    """
    value = clean_double(column)
    bounds = df.agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")).first()
    low, high = bounds["low"], bounds["high"]
    if low is None:
        raise ValueError(f"{column} has no values")
    if bins is None:
        quartiles = percentile_table(df, [column], {"q1": 0.25, "q3": 0.75}).first()
        bins = auto_bin_count(bounds["n"], low, high, quartiles["q3"] - quartiles["q1"])
    if low == high:
        low, high = low - 0.5, high + 0.5
    place = F.floor((value - F.lit(low)) / F.lit(high - low) * bins)
    counts = (
        df.where(value.isNotNull())
        .groupBy(F.least(place, F.lit(bins - 1)).cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    width = (high - low) / bins
    edges = df.sparkSession.range(bins).select(
        F.col("id").alias("bin"),
        (F.lit(low) + F.col("id") * width).alias("left_edge"),
        (F.lit(low) + (F.col("id") + 1) * width).alias("right_edge"),
    )
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


CELL_WIDTH = 1 / 8  # of the bandwidth: values of one cell are summed as powers of their offsets
TERMS = 12  # powers kept; the next one adds less than 1e-11 of a kernel's value
REACH = 9.0  # bandwidths beyond which a kernel is below 3e-18 of its height


def _hermite(terms: int) -> list[list[float]]:
    """Coefficients of the polynomials with He(k + 1) = t He(k) - k He(k - 1), lowest power first."""
    rows = [[1.0], [0.0, 1.0]]
    while len(rows) <= terms:
        k = len(rows) - 1
        up = [0.0, *rows[-1]]
        rows.append([u - (k * rows[-2][i] if i < len(rows[-2]) else 0.0) for i, u in enumerate(up)])
    return rows


def density_curve(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott bandwidth.

    Values are summed once, by narrow cells, as powers of their offsets from the cell's
    centre; the kernel around a centre is a Hermite series in those powers. So a value
    never meets the grid, only the cells do, and each just the points in its reach: past
    that a kernel is below double precision. The curve is that of all pairs to 1e-9.
    """
    value = clean_double(column)
    s = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high")).first()
    if not s["n"] or s["n"] < 2 or not s["sd"]:
        raise ValueError(f"{column} needs at least two different values")
    low, width = s["low"], s["sd"] * s["n"] ** (-0.2)
    step = (s["high"] - low) / (points - 1)
    cell = F.floor((F.col("v") - low) / (width * CELL_WIDTH))
    centre = (F.col("cell") + 0.5) * (width * CELL_WIDTH)
    offset = ((F.col("v") - low) - centre) / width
    powers = [F.lit(1.0)]
    for _ in range(TERMS):
        powers.append(powers[-1] * F.col("e"))
    cells = (
        df.select(value.alias("v")).where("v IS NOT NULL").withColumn("cell", cell).select("cell", offset.alias("e"))
        .groupBy("cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    )
    series = []  # coefficient of each power of t, over the sums of a cell
    hermite = _hermite(TERMS)
    for j in range(TERMS + 1):
        terms = [F.col(f"m{k}") * (hermite[k][j] / math.factorial(k)) for k in range(j, TERMS + 1) if hermite[k][j]]
        series.append(reduce(lambda a, b: a + b, terms).alias(f"c{j}"))
    first, last = F.ceil((centre - REACH * width) / step), F.floor((centre + REACH * width) / step)
    first, last = F.greatest(F.lit(0), first).cast("int"), F.least(F.lit(points - 1), last).cast("int")
    near = cells.select(centre.alias("centre"), first.alias("first"), last.alias("last"), *series).where("first <= last")
    spread = near.withColumn("point", F.explode(F.sequence("first", "last")))
    t = (F.col("point") * F.lit(step) - F.col("centre")) / width
    spread = spread.withColumn("t", t)
    total = F.col(f"c{TERMS}")
    for j in range(TERMS - 1, -1, -1):
        total = total * F.col("t") + F.col(f"c{j}")
    sums = spread.groupBy("point").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * total).alias("sum"))
    # points that no kernel reaches have density zero
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    return grid.join(sums, "point", "left").select(
        "point", (F.lit(low) + F.col("point") * F.lit(step)).alias("x"),
        (F.coalesce("sum", F.lit(0.0)) / (s["n"] * width * math.sqrt(2 * math.pi))).alias("density"),
    )


def box_stats(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), **options) -> DataFrame:
    """Box-plot summary per column (and group): quartiles, whiskers, outlier count.

    Whiskers end at the last value inside the fences.
    """
    fences = materialise(iqr_fences(df, columns, by, **options))  # a row per column and group, of known size
    entries = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    long = df.selectExpr(*[f"`{b}` as `g_{b}`" for b in by], f"stack({len(columns)}, {entries}) as (`c`, `value`)")
    long = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    same = [F.col("c") == F.col("column")] + [F.col(f"g_{b}").eqNullSafe(F.col(b)) for b in by]
    inside = F.col("value").between(F.col("low"), F.col("high"))
    keys = [*by, "column"]
    ends = long.join(fences, same).groupBy(*keys, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
        F.count("*").alias("n"),
    )
    return ends


def category_counts(df: DataFrame, column: str, hue: str | None = None) -> DataFrame:
    keys = [column] if hue is None else [column, hue]
    return df.groupBy(*keys).agg(F.count("*").alias("n"))
