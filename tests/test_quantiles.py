import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import quantiles as Q

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame(
        {
            "g": rng.choice(["a", "b", "hot"], n, p=[0.1, 0.2, 0.7]),
            "x": rng.exponential(5, n),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 20, n)),
            "k": rng.integers(0, 9, n).astype(float),
        }
    )
    pdf.loc[::17, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).persist()


@pytest.mark.parametrize("buckets", [5, 400])
def test_percentiles_match_pandas(data, monkeypatch, buckets):
    pdf, df = data
    monkeypatch.setattr(Q, "ROWS_PER_BUCKET", 3000 // buckets)
    got = {(r["column"], r["probability"]): r["value"] for r in Q.percentiles(df, ["x", "hot", "k"], PROBS).collect()}
    for c in ("x", "hot", "k"):
        for p in PROBS:
            assert got[c, p] == pytest.approx(pdf[c].quantile(p), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("gather", [1, 30])
def test_brackets_are_sketched_again_until_they_are_small(data, monkeypatch, gather):
    pdf, df = data
    monkeypatch.setattr(Q, "GATHER", gather)
    monkeypatch.setattr(Q, "SKETCH", 40)
    monkeypatch.setattr(Q, "MARGIN", 3 / 40)
    got, _ = Q.column_percentiles(df, ["x", "hot", "k"], PROBS)
    for (c, p), value in got.items():
        assert value == pytest.approx(pdf[c].quantile(p), rel=1e-12, abs=1e-12)


def test_brackets_that_miss_are_widened(data, monkeypatch):
    pdf, df = data
    monkeypatch.setattr(Q, "MARGIN", 0.0)
    monkeypatch.setattr(Q, "SKETCH", 8)
    got, _ = Q.column_percentiles(df, ["x", "hot"], PROBS)
    for (c, p), value in got.items():
        assert value == pytest.approx(pdf[c].quantile(p), rel=1e-12, abs=1e-12)


def test_grouped_percentiles(data, monkeypatch):
    pdf, df = data
    monkeypatch.setattr(Q, "ROWS_PER_BUCKET", 50)
    got = {(r["g"], r["column"], r["probability"]): r["value"] for r in Q.percentiles(df, ["x", "hot"], PROBS, ["g"]).collect()}
    assert len(got) == 3 * 2 * len(PROBS)
    for g, part in pdf.groupby("g"):
        for c in ("x", "hot"):
            for p in PROBS:
                assert got[g, c, p] == pytest.approx(part[c].quantile(p), rel=1e-12, abs=1e-12)


def test_percentiles_with_misleading_splitters(data, monkeypatch):
    """Selection stays exact when the splitters are useless."""
    pdf, df = data
    monkeypatch.setattr(Q, "_splitters", lambda values, columns, buckets, total: {c: [1e9] for c in columns})
    got = {(r["g"], r["probability"]): r["value"] for r in Q.percentiles(df, ["hot"], PROBS, ["g"]).collect()}
    assert got == pytest.approx({(g, p): part["hot"].quantile(p) for g, part in pdf.groupby("g") for p in PROBS})


def test_empty_column_gives_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert [r["value"] for r in Q.percentiles(df, ["x"], [0.5]).collect()] == [None]


def test_global_rank_orders_everything(spark):
    rng = np.random.default_rng(5)
    values = [(int(i), int(v)) for i, v in enumerate(rng.integers(0, 3, 500))]
    df = spark.createDataFrame(values, "id bigint, v int")
    ranked = Q.global_rank(df, [F.desc("v"), F.col("id")], partitions=5).collect()
    expected = sorted(values, key=lambda r: (-r[1], r[0]))
    assert [(r["id"], r["v"]) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    assert sorted(r["rank"] for r in ranked) == list(range(1, 501))


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 10, 11, 23, 101])
def test_quartile_of_rank_is_qcut_on_ranks(spark, n):
    df = spark.range(1, n + 1).select("id", Q.quartile_of_rank(F.col("id"), F.lit(n)).alias("q"))
    expected = pd.qcut(pd.Series(range(1, n + 1)), 4, labels=[1, 2, 3, 4]).astype(int)
    assert [r["q"] for r in df.orderBy("id").collect()] == list(expected)


@pytest.mark.parametrize("descending", [False, True])
def test_quartile_by_value_is_qcut(spark, descending):
    values = pd.Series(np.random.default_rng(1).integers(0, 60, 97).astype(float))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id bigint, v double")
    labels = [4, 3, 2, 1] if descending else [1, 2, 3, 4]
    got = Q.quartile_by_value(df, "v", "q", descending).orderBy("id").collect()
    assert [r["q"] for r in got] == list(pd.qcut(values, 4, labels=labels).astype(int))


def test_equal_quartile_edges_raise(spark):
    df = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "v double")
    with pytest.raises(ValueError, match="not unique"):
        Q.quartile_by_value(df, "v", "q")


def test_columns_without_values_keep_their_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "x double, gone double")
    got = {(r["column"], r["probability"]): r["value"] for r in Q.percentiles(df, ["x", "gone"], [0.0, 0.5]).collect()}
    assert got == {("x", 0.0): 1.0, ("x", 0.5): 2.0, ("gone", 0.0): None, ("gone", 0.5): None}
    nothing = df.where("x < 0")
    assert {r["value"] for r in Q.percentiles(nothing, ["x", "gone"], [0.5]).collect()} == {None}


def test_crowded_bucket_is_ranked_range_by_range(spark, monkeypatch):
    """One bucket holds everything and spreads over several ranges."""
    rng = np.random.default_rng(8)
    values = pd.Series(rng.normal(0, 1, 20_000))
    df = spark.createDataFrame(values.to_frame("v")).repartition(4)
    monkeypatch.setattr(Q, "_splitters", lambda *_: {"v": [1e9]})
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["probability"]: r["value"] for r in Q.percentiles(df, ["v"], PROBS).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == pytest.approx({p: values.quantile(p) for p in PROBS}, rel=1e-12)


def test_null_is_a_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("b", None)], "g string, x double")
    got = {r["g"]: r["value"] for r in Q.percentiles(df, ["x"], [0.5], ["g"]).collect()}
    assert got == {None: 2.0, "a": 5.0}
