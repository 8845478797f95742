import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.functions import tails
from tallyframe.operators import association, orders, profile, segments


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame(
        {
            "level": rng.choice(["u", "v", "w"], n),
            "two": rng.choice(["p", "q"], n),
            "flag": rng.integers(0, 2, n),
            "rare": (rng.random(n) < 0.02).astype(int),
            "x": rng.normal(0, 1, n),
            "y": rng.exponential(3, n),
        }
    )
    pdf["x"] = pdf["x"] + pdf["flag"] * 0.6
    pdf.loc[3, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf).persist()


# known values of the distributions
@pytest.mark.parametrize("x,dof,p", [(3.841458820694124, 1, 0.05), (9.487729036781154, 4, 0.05), (18.420680743952367, 2, 1e-4), (0.0, 3, 1.0)])
def test_chi_square_tail(x, dof, p):
    assert tails.chi_square_p(x, dof) == pytest.approx(p, rel=1e-9)


@pytest.mark.parametrize("dof", [2, 4, 10, 40])
def test_even_dof_tail_closed_form(dof):
    for x in (0.3, 5.0, 60.0):
        closed = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))
        assert tails.chi_square_p(x, dof) == pytest.approx(closed, rel=1e-10)


def test_correlation_p_known_values():
    # t = 2.0 with 10 degrees and t = 12.7062 with 1 degree of freedom
    assert tails.correlation_p(2 / math.sqrt(4 + 10), 12) == pytest.approx(0.07338803477074, rel=1e-9)
    assert tails.correlation_p(12.7062047364 / math.sqrt(12.7062047364**2 + 1), 3) == pytest.approx(0.05, rel=1e-6)
    assert tails.correlation_p(1.0, 10) == 0.0 and tails.correlation_p(0.5, 2) is None


def test_describe_and_profile(data):
    pdf, df = data
    got = {r["column"]: r for r in profile.describe(df, ["x", "y"]).collect()}
    for c in ("x", "y"):
        d = pdf[c].describe()
        for mine, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("q25", "25%"), ("q50", "50%"), ("max", "max")):
            assert got[c][mine] == pytest.approx(d[theirs])
    columns = {r["column"]: r for r in profile.column_profile(df).collect()}
    assert columns["y"]["n_null"] == 1 and columns["level"]["n_distinct"] == 3 and columns["flag"]["dtype"] == "bigint"


def test_histogram_matches_numpy(data):
    pdf, df = data
    counts, edges = np.histogram(pdf["x"], bins=13)
    got = profile.histogram(df, "x", 13).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(counts)
    assert [r["left_edge"] for r in got] == pytest.approx(list(edges[:-1]))
    assert profile.auto_bin_count(400, pdf["x"].min(), pdf["x"].max(), pdf["x"].quantile(0.75) - pdf["x"].quantile(0.25)) == len(
        np.histogram_bin_edges(pdf["x"], "auto")) - 1


def test_constant_column_histogram(spark):
    got = profile.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 2).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(np.histogram([2.0] * 3, bins=2)[0])


def test_density_integrates_to_about_one(data):
    pdf, df = data
    got = profile.density_curve(df, "x", 100).orderBy("point").collect()
    x, d = [r["x"] for r in got], [r["density"] for r in got]
    width = pdf["x"].std() * len(pdf) ** -0.2
    direct = np.exp(-0.5 * ((x[40] - pdf["x"]) / width) ** 2).sum() / (len(pdf) * width * math.sqrt(2 * math.pi))
    assert d[40] == pytest.approx(direct) and 0.9 < np.trapezoid(d, x) < 1


def test_caps_and_boxes(data):
    pdf, df = data
    q1, q3 = pdf["y"].quantile([0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    capped = profile.cap_outliers(df, ["y"]).toPandas()["y"]
    assert capped.max() == pytest.approx(min(high, pdf["y"].max())) and capped.isna().sum() == 1
    inside = pdf["y"][(pdf["y"] >= low) & (pdf["y"] <= high)]
    box = profile.box_stats(df, ["y"]).first()
    assert (box["whisker_low"], box["whisker_high"]) == (inside.min(), inside.max())
    assert box["n_outliers"] == len(pdf) - 1 - len(inside)


def test_feature_preparation_order(spark):
    df = spark.createDataFrame([("A, B", 1.0), ("A", 2.0), (None, 3.0), ("B", 100.0)], "label string, x double")
    got = profile.prepare_features(df, "label", ["x"], ["x"]).toPandas()
    exploded = pd.Series([1.0, 1.0, 2.0, 3.0, 100.0])
    q1, q3 = exploded.quantile([0.25, 0.75])
    assert sorted(got["x"]) == pytest.approx(sorted(np.log1p(exploded.clip(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))))
    assert got["A"].sum() == 2 and got["B"].sum() == 2 and len(got) == 5
    hot = profile.add_indicators(df, "label", multi_hot=True).toPandas()
    assert list(hot["A"]) == [1, 1, 0, 0]


def test_correlation_matrix(data):
    pdf, df = data
    columns = ["x", "y", "flag"]
    expected = pdf[columns].corr()
    got = {(r["column_a"], r["column_b"]): r["r"] for r in association.correlation_matrix(df, columns).collect()}
    assert len(got) == 9
    for a in columns:
        for b in columns:
            assert got[a, b] == pytest.approx(expected.loc[a, b])


def test_point_biserial_keeps_significant_only(data):
    pdf, df = data
    got = association.point_biserial(df, ["flag", "rare"], ["x"]).collect()
    assert [r["binary_column"] for r in got] == ["flag"]
    assert got[0]["correlation"] == pytest.approx(pdf["flag"].corr(pdf["x"])) and got[0]["p_text"].count("e-") == 1


def chi(table, yates):
    table = np.asarray(table, float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    gap = np.abs(table - expected)
    return ((gap - np.minimum(0.5, gap) * yates) ** 2 / expected).sum()


def test_chi_square_statistics(data):
    pdf, df = data
    got = {(r["categorical_column"], r["binary_column"]): r for r in association.chi_square(df, ["level", "two"], ["flag", "rare"], False).collect()}
    for c in ("level", "two"):
        for b in ("flag", "rare"):
            table = pd.crosstab(pdf[c], pdf[b])
            dof = (table.shape[0] - 1) * (table.shape[1] - 1)
            assert got[c, b]["dof"] == dof
            assert got[c, b]["chi_square"] == pytest.approx(chi(table, dof == 1))


def test_chi_square_with_unseen_cells_and_single_level(spark):
    rows = [("a", 1)] * 6 + [("b", 0)] * 5 + [("c", 0)] * 3 + [("c", 1)] * 2
    df = spark.createDataFrame(rows, "c string, f int").withColumn("same", F.lit("s"))
    got = {r["categorical_column"]: r for r in association.chi_square(df, ["c", "same"], ["f"], False).collect()}
    assert got["c"]["chi_square"] == pytest.approx(chi([[0, 6], [5, 0], [3, 2]], False))
    assert (got["same"]["dof"], got["same"]["chi_square"], got["same"]["p_value"]) == (0, 0.0, 1.0)
    two = association.chi_square(df.where("c <> 'c'"), ["c"], ["f"], False).first()
    assert two["chi_square"] == pytest.approx(chi([[0, 6], [5, 0]], True))


def test_flag_share_without_any_hit(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0)], "g string, f int")
    assert {r["share"] for r in association.flag_shares(df, "g", ["f"]).collect()} == {0.0}


@pytest.fixture(scope="module")
def lines(spark):
    rows = [
        ("x", 2.0, 20.0, 0.0, 2.0, 0.0), ("x", -1.0, 0.0, -10.0, 0.0, -1.0), ("y", 3.0, 30.0, 0.0, 3.0, 0.0),
        ("z", -2.0, 0.0, -5.0, 0.0, -2.0), ("x", 0.0, 99.0, -99.0, 9.0, -9.0),
    ]
    return spark.createDataFrame(rows, "item string, quantity double, revenue double, refunds double, units_sold double, units_returned double")


def test_order_totals_and_rates(lines):
    totals = orders.order_totals(lines, ["item"])
    summary = orders.financial_summary(totals).first()
    assert (summary["gross"], summary["refunds"], summary["net"], summary["return_ratio_pct"]) == (50.0, 15.0, 35.0, 100.0)
    rates = orders.return_rates(totals)
    assert [(r["item"], r["return_rate"]) for r in rates.collect()] == [("x", 50.0)]
    nets = {r["item"]: r["net"] for r in orders.period_net(totals, "item").collect()}
    assert nets == {"x": 10.0, "y": None, "z": None}
    assert orders.rate_summary(rates, "item").first()["highest_key"] == "x"


def test_rfm_by_hand(spark):
    """Eight buyers with scores worked out by hand; the ninth only returned goods, on the last day of all."""
    # buyer: (days before the last day, sales, paid per sale)
    sales = {1: (1, 8, 10.0), 2: (2, 7, 10.0), 3: (10, 6, 5.0), 4: (11, 5, 5.0), 5: (20, 4, 4.0), 6: (21, 3, 4.0), 7: (30, 2, 1.0), 8: (31, 1, 1.0)}
    last = pd.Timestamp("2024-12-01")
    rows = [(b, (last - pd.Timedelta(days=d + i)).to_pydatetime(), p, 1) for b, (d, n, p) in sales.items() for i in range(n)]
    lines = spark.createDataFrame([*rows, (9, last.to_pydatetime(), 5.0, 0)], "buyer int, day timestamp, paid double, sale int")
    got = {r["buyer"]: r for r in segments.rfm_scores(segments.rfm_table(lines, "buyer", "day", "sale", "paid")).collect()}
    assert {b: r["recency"] for b, r in got.items()} == {b: d + 1 for b, (d, _, _) in sales.items()}
    scores = {1: 4, 2: 4, 3: 3, 4: 3, 5: 2, 6: 2, 7: 1, 8: 1}
    for b, score in scores.items():
        assert (got[b]["r_score"], got[b]["f_score"], got[b]["m_score"]) == (score, score, score)
    names = {4: "Champions", 3: "Loyal", 2: "Needs Attention", 1: "At Risk"}
    assert {b: r["segment"] for b, r in got.items()} == {b: names[s] for b, s in scores.items()}
