import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import audits, filters, joins, params, ranking
from tallyframe.operators import rows as row_ops


@pytest.fixture(scope="module")
def left(spark):
    return spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "k int, v string")


def keyed(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "r int")


@pytest.mark.parametrize(
    "right,expected",
    [
        ((2,), [(1, "a")]),
        ((2, None), []),
        ((), [(1, "a"), (2, "b"), (2, "b"), (None, "n")]),
        ((9,), [(1, "a"), (2, "b"), (2, "b")]),
    ],
)
def test_not_in_follows_sql_null_rules(spark, left, rows, right, expected):
    other = keyed(spark, *right)
    got = rows(joins.not_in(left, "k", other, "r"))
    assert got == sorted(expected, key=repr)
    left.createOrReplaceTempView("l")
    other.createOrReplaceTempView("o")
    assert got == rows(spark.sql("SELECT * FROM l WHERE k NOT IN (SELECT r FROM o)"))


def test_full_union_drops_repeats_and_bag_keeps_them(spark, left, rows):
    right = spark.createDataFrame([(2, "x"), (3, "y")], "r int, w string")
    on, cols = F.col("k") == F.col("r"), [F.col("v"), F.col("w")]
    assert rows(joins.full_union(left, right, on, cols)) == sorted(
        [("a", None), ("b", "x"), ("n", None), (None, "y")], key=repr
    )
    assert len(rows(joins.full_union(left, right, on, cols, distinct=False))) == 5


def test_with_count_keeps_rows_without_match(spark, left, rows):
    got = rows(joins.with_count(left, "k", keyed(spark, 2, 2, 2), "r", "n"))
    assert got == sorted([(1, "a", 0), (2, "b", 3), (2, "b", 3), (None, "n", 0)], key=repr)


def test_above_group_average_equals_correlated_form(spark, rows):
    df = spark.createDataFrame([(i, i % 3 and 7, float((i * 37) % 50)) for i in range(60)], "id int, g int, x double")
    df.createOrReplaceTempView("t")
    sql = "SELECT * FROM t a WHERE x > (SELECT avg(x) FROM t b WHERE b.g = a.g)"
    assert rows(joins.above_group_average(df, "g", "x")) == rows(spark.sql(sql))


def test_date_spine_counts_empty_days(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 5, 7),), (dt.datetime(2024, 3, 5, 9),), (dt.datetime(2024, 3, 2),)], "t timestamp")
    got = {str(r["day"]): r["n_rows"] for r in joins.date_spine(df, "t", 4).collect()}
    assert got == {"2024-03-02": 1, "2024-03-03": 0, "2024-03-04": 0, "2024-03-05": 2}


def test_same_period_modes_differ(spark, rows):
    day = lambda y, m: dt.datetime(y, m, 1)
    df = spark.createDataFrame([(5, day(2024, 1)), (6, day(2024, 1)), (7, day(2023, 1)), (8, day(2024, 2))], "k int, t timestamp")
    assert rows(joins.same_period_keys(df, "k", "t", 5)) == [(5,), (6,)]
    assert rows(joins.same_period_keys(df, "k", "t", 5, with_year=False)) == [(5,), (6,), (7,)]


def test_scalar_subquery_with_two_rows_fails(spark, left):
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        left.select(left.where("k = 2").select("v").scalar()).collect()


def test_aligned_series(spark, rows):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, 7.0)], "k int, b double")
    assert rows(joins.aligned([a, b], "k")) == [(1, 1.0, 5.0)]
    assert len(rows(joins.aligned([a, b], "k", "full"))) == 3


def test_filter_or_keep(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 9), ("b", 1), ("b", None), (None, 9), (None, 1)], "g string, x int")
    assert rows(filters.filter_or_keep(df, F.col("x") > 5, ["g"])) == sorted([("a", 9), ("b", 1), ("b", None), (None, 9)], key=repr)
    assert len(rows(filters.filter_or_keep(df, F.col("x") > 50))) == 6
    assert len(rows(filters.filter_or_keep(df, F.col("x") > 5))) == 2


def test_split_and_head_tail(spark, rows):
    df = spark.createDataFrame([(i - 2,) for i in range(5)] + [(None,)], "x int")
    positive, negative = filters.split_by_sign(df, "x")
    assert rows(positive) == [(1,), (2,)] and rows(negative) == [(-1,), (-2,)]
    assert rows(filters.last_rows(df, ["x"], 2)) == [(1,), (2,)]


# the rows that must be flagged by each rule
def test_primary_key_audit(spark, rows):
    people = spark.createDataFrame([(1, "Smith"), (2, "Doe"), (1, "Brown"), (None, "X"), (None, "Y")], "id int, name string")
    assert rows(audits.primary_key_violations(people, ["id"])) == sorted([(1, 2, "duplicate key"), (None, 2, "null key")], key=repr)
    assert rows(audits.duplicate_keys(people, ["id"])) == [(1, 2)]


def test_null_check_and_foreign_key_audits(spark, rows):
    people = spark.createDataFrame([(1, "Smith", 30), (2, "Doe", None), (3, None, 17)], "id int, name string, age int")
    orders = spark.createDataFrame([(1001, 1), (1002, 999), (1003, None)], "oid int, pid int")
    assert rows(audits.null_rows(people, ["name"])) == [(3, None, 17)]
    assert rows(audits.check_violations(people, F.col("age") >= 18)) == [(3, None, 17)]
    assert rows(audits.orphans(orders, "pid", people, "id")) == [(1002, 999)]


def test_restrict_and_cascade(spark, rows):
    people = spark.createDataFrame([(1,), (2,)], "id int")
    orders = spark.createDataFrame([(1001, 1), (1002, None)], "oid int, pid int")
    assert rows(audits.restrict_deletes(people, "id", orders, "pid")) == [(1, True), (2, False)]
    mapping = spark.createDataFrame([(1, 4)], "old_key int, new_key int")
    assert rows(audits.cascade_keys(people, "id", mapping)) == [(2,), (4,)]
    assert rows(audits.cascade_keys(orders, "pid", mapping)) == sorted([(1001, 4), (1002, None)], key=repr)


def test_row_changes(spark, rows):
    df = spark.createDataFrame([(1, 10), (2, None), (3, 30)], "id int, x int")
    assert rows(row_ops.delete_where(df, F.col("x") > 20)) == sorted([(1, 10), (2, None)], key=repr)
    changed = row_ops.update_where(df, F.col("x") > 20, {"x": F.col("id"), "id": F.col("x")})
    assert rows(changed) == sorted([(1, 10), (2, None), (30, 3)], key=repr)
    defaulted = row_ops.with_default(df, "x", 99)
    assert rows(defaulted) == rows(df)
    assert rows(row_ops.with_default(df, "city", "here"))[0][2] == "here"
    with pytest.raises(ValueError):
        row_ops.rename_column(df, "nope", "y")


def test_ranking(spark, rows):
    df = spark.createDataFrame([("a", i, i % 4) for i in range(20)] + [("b", 99, 1)], "g string, id int, s int")
    best = rows(ranking.best_per_key(df, ["g"], [F.desc("s"), F.col("id")]))
    assert best == [("a", 3, 3), ("b", 99, 1)]
    once = rows(ranking.sample_per_group(df, ["g"], 5, ["id"]))
    assert once == rows(ranking.sample_per_group(df.repartition(3), ["g"], 5, ["id"])) and len(once) == 6
    assert rows(ranking.sample_per_group(df, ["g"], 5, ["id"], seed=1)) != once
    ordered = rows(ranking.in_label_order(df.where("g = 'b'"), "g", ["b", "zz"]))
    assert sorted(r[1] for r in ordered) == [1, 2]


def test_top_per_group_limits_before_the_shuffle(spark, capsys):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id")
    ranking.top_per_group(df, ["g"], [F.col("id")], 3).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Exchange") < plan.rindex("WindowGroupLimit")


def test_period_change_handles_zero(spark):
    df = spark.createDataFrame([("2024-01", 0.0), ("2024-02", 5.0), ("2024-03", 10.0)], "m string, v double")
    got = [r["change_pct"] for r in ranking.period_change(df, "m", "v").orderBy("m").collect()]
    assert got == [None, None, 100.0]


def test_parameter_queries(spark, left):
    left.createOrReplaceTempView("left_rows")
    assert params.count_rows_of(spark, "left_rows").first()["total_rows"] == 4
    assert params.total_for(left, "k", 77, "k").first()["total"] is None
    assert params.rows_for(left, "k", 2, ["v"]).count() == 2
    with pytest.raises(ValueError):
        params.count_rows_of(spark, "left_rows; DROP TABLE x")
