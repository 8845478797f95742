"""Correlations, contingency tables and association tests.

Every grid of tests is one pass over the data; probabilities are attached to the
few result rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.tails import chi_square_tail, correlation_tail
from tallyframe.operators.quantiles import clean_double

SIGNIFICANT = 0.05
PAIRED = 32  # columns whose pairs are single aggregates
BLOCK = 64  # columns of a block of products
HEAD = 1_000  # rows looked at for a value of every column; any value will do


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlations as rows (column_a, column_b, r), both orders and the diagonal.

    Up to ``PAIRED`` columns every pair is one aggregate; wider sets, whose pairs would
    make too many, go through ``blocked_correlations`` with the same result.
    """
    if len(columns) > PAIRED:
        return blocked_correlations(df, columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    aggregates = [F.corr(clean_double(a), clean_double(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    aggregates += [F.count(clean_double(c)).alias(f"n_{c}") for c in columns]
    cells = [f"'{a}', '{b}', r{i}, '{b}', '{a}', r{i}" for i, (a, b) in enumerate(pairs)]
    cells += [f"'{c}', '{c}', if(`n_{c}` > 0, 1.0D, cast(null as double))" for c in columns]
    rows = df.agg(*aggregates).selectExpr(f"stack({len(columns) ** 2}, {', '.join(cells)}) as (column_a, column_b, r)")
    return rows.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def blocked_correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``correlation_matrix`` for many columns, from one scan that sums products of blocks of columns.

    Each task holds the sums over pairs where both values are there, as matrix products
    of its batches, and hands on one row per pair of columns. Values are taken relative
    to one value of their column, which keeps large offsets from eating up the digits.
    """
    columns = list(columns)
    m = len(columns)
    rows = df.select(*[clean_double(c).alias(f"x{i}") for i, c in enumerate(columns)])
    head = rows.limit(HEAD).agg(*[F.first(f"x{i}", ignorenulls=True) for i in range(m)]).first()
    base = np.array([0.0 if v is None else v for v in head])
    blocks = [(a, b) for a in range(0, m, block) for b in range(a, m, block)]
    fields = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - base
            there = ~np.isnan(x)
            x, there = np.where(there, x, 0.0), there.astype(float)
            for a, b in blocks:
                xa, ta, xb, tb = x[:, a : a + block], there[:, a : a + block], x[:, b : b + block], there[:, b : b + block]
                found = np.stack([ta.T @ tb, xa.T @ tb, ta.T @ xb, (xa * xa).T @ tb, ta.T @ (xb * xb), xa.T @ xb])
                total[a, b] = total[a, b] + found if (a, b) in total else found
        for (a, b), found in total.items():
            i, j = np.nonzero(np.arange(a, a + found.shape[1])[:, None] <= np.arange(b, b + found.shape[2]))
            sums = [pa.array(f[i, j]) for f in found]
            yield pa.RecordBatch.from_arrays([pa.array((a + i).astype(np.int32)), pa.array((b + j).astype(np.int32)), *sums], names=["i", "j", *fields])

    partial = rows.mapInArrow(products, "i int, j int, " + ", ".join(f"{f} double" for f in fields))
    sums = partial.groupBy("i", "j").agg(*[F.sum(f).alias(f) for f in fields])
    spread_x, spread_y = (F.col(f"s{v}{v}") - F.col(f"s{v}") * F.col(f"s{v}") / F.col("n") for v in "xy")
    shared = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    r = F.when(F.col("i") == F.col("j"), F.when(F.col("n") > 0, 1.0)).otherwise(
        F.when((F.col("n") > 1) & (spread_x > 0) & (spread_y > 0), shared / F.sqrt(spread_x * spread_y))
    )
    names = F.array(*[F.lit(c) for c in columns])
    half = sums.select("i", "j", r.alias("r"))
    both = half.unionByName(half.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    # columns that no task has seen any row of are still listed
    grid = df.sparkSession.range(m * m).select(F.expr(f"cast(id div {m} as int)").alias("i"), (F.col("id") % m).cast("int").alias("j"))
    return grid.join(both, ["i", "j"], "left").select(
        F.element_at(names, F.col("i") + 1).alias("column_a"), F.element_at(names, F.col("j") + 1).alias("column_b"), "r"
    )


def _correlations(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """One aggregation for all pairs: r and the number of complete pairs."""
    if not pairs:
        raise ValueError("no column pairs")
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = clean_double(a), clean_double(b)
        aggregates += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    entries = ", ".join(f"'{a}', '{b}', r{i}, n{i}" for i, (a, b) in enumerate(pairs))
    rows = df.agg(*aggregates).selectExpr(f"stack({len(pairs)}, {entries}) as (column_a, column_b, r, n)")
    return rows.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def point_biserial(df: DataFrame, binary: Sequence[str], numeric: Sequence[str], significant_only: bool = True) -> DataFrame:
    """Correlation of every 0/1 column with every numeric column, strongest first.

    ``p_text`` is the probability as ``%.4e``; only p < 0.05 is kept by default.
    """
    pairs = _correlations(df, [(b, n) for b in binary for n in numeric])
    tested = pairs.withColumn("p_value", correlation_tail(F.col("r"), F.col("n").cast("double")))
    if significant_only:
        tested = tested.where(F.col("p_value") < SIGNIFICANT)
    return tested.select(
        F.col("column_a").alias("binary_column"),
        F.col("column_b").alias("numeric_column"),
        F.col("r").alias("correlation"),
        "p_value",
        F.format_string("%.4e", "p_value").alias("p_text"),
    ).orderBy(F.abs("correlation").desc(), "binary_column", "numeric_column")


def contingency(df: DataFrame, categorical: Sequence[str], binary: Sequence[str]) -> DataFrame:
    """Long counts (categorical_column, level, binary_column, flag, n) for every pairing.

    Rows are first counted per combination of all columns, so the pairings are
    spread over distinct combinations instead of over the data.
    """
    combos = df.groupBy(*categorical, *binary).agg(F.count("*").alias("n"))
    cats = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in categorical])
    flags = F.array(*[F.struct(F.lit(b).alias("name"), F.col(b).cast("string").alias("flag")) for b in binary])
    spread = combos.select("n", F.explode(cats).alias("c"), flags.alias("flags")).select(
        "n", "c", F.explode("flags").alias("b")
    )
    present = spread.where(F.col("c.level").isNotNull() & F.col("b.flag").isNotNull())
    return present.groupBy(
        F.col("c.name").alias("categorical_column"),
        F.col("c.level").alias("level"),
        F.col("b.name").alias("binary_column"),
        F.col("b.flag").alias("flag"),
    ).agg(F.sum("n").alias("n"))


def chi_square(df: DataFrame, categorical: Sequence[str], binary: Sequence[str], significant_only: bool = True) -> DataFrame:
    """Chi-square test of every categorical column against every 0/1 column, strongest first.

    With one degree of freedom the continuity correction is applied. Windows run
    over contingency cells, of which there are levels x 2 per pairing.
    """
    cells = contingency(df, categorical, binary)
    pair = ["categorical_column", "binary_column"]
    cells = cells.select(
        *pair,
        F.col("n").cast("double").alias("seen"),
        F.sum("n").over(Window.partitionBy(*pair, "level")).cast("double").alias("row"),
        F.sum("n").over(Window.partitionBy(*pair, "flag")).cast("double").alias("col"),
        F.sum("n").over(Window.partitionBy(*pair)).cast("double").alias("total"),
        "level",
        "flag",
    ).withColumn("expected", F.col("row") * F.col("col") / F.col("total"))
    gap = F.abs(F.col("seen") - F.col("expected"))
    sums = cells.groupBy(*pair).agg(
        F.sum(gap * gap / F.col("expected")).alias("plain"),
        F.sum("expected").alias("expected_seen"),
        F.count("*").alias("n_cells"),
        F.countDistinct("level").alias("levels"),
        F.countDistinct("flag").alias("flags"),
        F.max("total").alias("total"),
        F.max(gap).alias("gap"),
        F.max("row").alias("row_max"),
        F.max("col").alias("col_max"),
    )
    grid = F.col("levels") * F.col("flags")
    # unseen cells have count 0 and contribute their expectation
    unseen = F.when(F.col("n_cells") < grid, F.col("total") - F.col("expected_seen")).otherwise(0.0)
    # in a 2x2 table every cell has the same gap, and the margins give all four expectations
    r1, c1, n = F.col("row_max"), F.col("col_max"), F.col("total")
    one = F.lit(1.0)
    inverse = n * (one / r1 + F.try_divide(one, n - r1)) * (one / c1 + F.try_divide(one, n - c1))
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    dof = (F.col("levels") - 1) * (F.col("flags") - 1)
    tested = sums.select(
        *pair,
        dof.alias("dof"),
        F.when(dof == 0, 0.0).when(dof == 1, shrunk * shrunk * inverse).otherwise(F.col("plain") + unseen).alias("chi_square"),
    ).withColumn("p_value", chi_square_tail("chi_square", F.col("dof").cast("double")))
    if significant_only:
        tested = tested.where(F.col("p_value") < SIGNIFICANT)
    return tested.withColumn("p_text", F.format_string("%.4e", "p_value")).orderBy(F.desc("chi_square"), *pair)


def row_shares(df: DataFrame, row: str, column: str, count_as: str = "n", share_as: str = "row_share") -> DataFrame:
    """Counts per (row, column) and their share of the row; windows run over the counts."""
    counts = df.groupBy(row, column).agg(F.count("*").alias(count_as))
    return counts.withColumn(share_as, F.col(count_as) / F.sum(count_as).over(Window.partitionBy(row)))


def flag_shares(df: DataFrame, level: str, flags: Sequence[str]) -> DataFrame:
    """Share of rows with each flag set, per level, as rows (level, flag, n, n_set, share).

    All flags come from one aggregation; a flag that never occurs has share 0.
    """
    aggregates = []
    for f in flags:
        aggregates += [F.count(f).alias(f"{f}__n"), F.count_if(F.col(f) == 1).alias(f"{f}__n_set")]
    wide = df.where(F.col(level).isNotNull()).groupBy(level).agg(*aggregates)
    entries = ", ".join(f"'{f}', `{f}__n`, `{f}__n_set`" for f in flags)
    long = wide.selectExpr(f"`{level}`", f"stack({len(flags)}, {entries}) as (`flag`, `n`, `n_set`)")
    return long.withColumn("share", F.try_divide(F.col("n_set").cast("double"), F.col("n")))
