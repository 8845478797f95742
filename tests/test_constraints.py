import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import association, constraints, group_functions, profile


@pytest.fixture(scope="module")
def company(spark):
    persons = [(1, "Smith", 30), (2, "Doe", None), (1, "Brown", 25), (3, None, 28), (None, "Nobody", 17), (1, "Third", 40)]
    orders = [(1001, 1), (1002, 999), (1003, None), (1003, 2), (None, 3)]
    return {
        "persons": spark.createDataFrame(persons, "id int, last_name string, age int").repartition(3),
        "orders": spark.createDataFrame(orders, "order_id long, person_id long").repartition(2),
        "empty": spark.createDataFrame([], "a int, b int"),
    }


RULES = [
    constraints.not_null("persons", "last_name"),
    constraints.unique("persons", "id"),
    constraints.primary_key("persons", "id"),
    constraints.check("persons", "age >= 18", "ck_age"),
    constraints.primary_key("orders", "order_id"),
    constraints.foreign_key("orders", ["person_id"], "persons", ["id"]),
    constraints.foreign_key("persons", ["id"], "empty", ["a"], name="fk_empty"),
    constraints.unique("empty", "a", "b"),
]


def test_audit_counts_every_kind_of_violation(company):
    got = {r.constraint_name: r.violations for r in constraints.audit(company, RULES).collect()}
    assert got == {
        "nn_persons_last_name": 1,
        "uq_persons_id": 2,  # id 1 three times; the missing id passes
        "pk_persons": 3,
        "ck_age": 1,  # the unknown age passes
        "pk_orders": 2,
        "fk_orders_person_id": 1,
        "fk_empty": 5,
        "uq_empty_a_b": 0,
    }


def test_audit_scans_every_table_once(company):
    plan = constraints.audit(company, RULES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1 and plan.count("Generate explode") == len(company)


def test_listing(spark):
    rows = {r.constraint_name: r for r in constraints.listing(spark, RULES).collect()}
    key = rows["fk_orders_person_id"]
    assert (key.rule, key.columns, key.referenced_table, key.on_delete, key.on_update) == ("FOREIGN KEY", "person_id", "persons", "RESTRICT", "CASCADE")
    assert rows["uq_empty_a_b"].columns == "a, b" and rows["ck_age"].expression == "age >= 18"
    with pytest.raises(ValueError, match="repeat"):
        constraints.listing(spark, [RULES[0], RULES[0]])
    with pytest.raises(ValueError, match="actions"):
        constraints.foreign_key("a", ["x"], "b", ["y"], on_delete="EXPLODE")
    with pytest.raises(ValueError, match="as many"):
        constraints.foreign_key("a", ["x"], "b", ["y", "z"])


def test_unknown_tables_are_refused(company):
    with pytest.raises(ValueError, match="persons"):
        constraints.audit({"orders": company["orders"]}, RULES)


def test_functions_over_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 7}", i, float(rng.integers(0, 50))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, x double").repartition(6)

    def update(state, part):
        return state[0] + len(part), max(state[1], part["x"].max()), state[2] ^ int(np.bitwise_xor.reduce(part["i"].to_numpy(dtype=np.int64)))

    def merge(a, b):
        return a[0] + b[0], max(a[1], b[1]), a[2] ^ b[2]

    found = group_functions.fold_groups(
        df, ["g"], ["i", "x"], lambda: (0, -1.0, 0), update, merge, lambda s: {"n": s[0], "top": s[1], "mixed": s[2]}, "n bigint, top double, mixed bigint"
    )
    got = {r.g: (r.n, r.top, r.mixed) for r in found.collect()}
    frame = pd.DataFrame(rows, columns=["g", "i", "x"])
    want = {}
    for g, part in frame.groupby(frame["g"].fillna("none")):
        want[None if g == "none" else g] = (len(part), part["x"].max(), int(np.bitwise_xor.reduce(part["i"].to_numpy())))
    assert got == want
    assert found.columns == ["g", "n", "top", "mixed"]
    none = group_functions.fold_groups(df.limit(0), ["g"], ["x"], list, lambda s, r: s, lambda a, b: a, lambda s: {"n": 0}, "n bigint")
    assert none.collect() == []
    with pytest.raises(ValueError, match="cannot be"):
        group_functions.fold_groups(df, ["g"], ["g"], list, update, merge, dict, "n bigint")


def test_hot_group_arrives_as_few_states(spark, monkeypatch):
    df = spark.range(20_000, numPartitions=5).select(F.lit("hot").alias("g"), "id")
    merged = spark.sparkContext.accumulator(0)

    def merge(a, b):
        merged.add(1)
        return a + b

    found = group_functions.fold_groups(
        df, ["g"], ["id"], lambda: 0, lambda s, r: s + int(r["id"].sum()), merge, lambda s: {"total": s}, "total bigint"
    )
    assert found.collect() == [("hot", sum(range(20_000)))]
    assert merged.value <= 5


def test_groups_reach_the_function_in_long_runs(spark):
    df = spark.range(4_000, numPartitions=4).select((F.col("id") % 50).alias("g"), F.col("id").alias("x"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = group_functions.fold_groups(
            df, ["g"], ["x"], lambda: (0, 0), lambda s, r: (s[0] + 1, s[1] + int(r["x"].sum())),
            lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda s: {"calls": s[0], "total": s[1]}, "calls long, total long",
        ).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r.g: r.total for r in found} == {g: sum(range(g, 4_000, 50)) for g in range(50)}
    assert sum(r.calls for r in found) <= 50 + 40  # a call for every group and every batch, not one for every group of a batch


def test_blocked_correlations_equal_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (400, 40)) @ rng.normal(0, 1, (40, 40)) + 1e6
    x[:, 5] = 3.0  # constant
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 6] = np.nan
    x[1:, 7], x[0, 7] = np.nan, 1.0
    columns = [f"c{i}" for i in range(40)]
    rows = [tuple(None if np.isnan(v) and (i + j) % 2 else float(v) for j, v in enumerate(r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns)).repartition(4).persist()
    wide = {(r.column_a, r.column_b): r.r for r in association.blocked_correlations(df, columns, block=16).collect()}
    pandas = pd.DataFrame(x, columns=columns).corr(min_periods=2)
    assert len(wide) == 1600
    for (a, b), r in wide.items():
        want = pandas.loc[a, b]
        if a == b:
            assert r == (None if a == "c6" else 1.0)
        else:
            assert (r is None and (np.isnan(want) or a == "c5" or b == "c5")) or r == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(association, "PAIRED", 3)
    few = columns[:4]
    through = {(r.column_a, r.column_b): r.r for r in association.correlation_matrix(df, few).collect()}
    monkeypatch.setattr(association, "PAIRED", 32)
    pairs = {(r.column_a, r.column_b): r.r for r in association.correlation_matrix(df, few).collect()}
    assert through == pytest.approx(pairs, abs=1e-9)


def test_density_of_clumps_and_far_values(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(300, 2.0), rng.normal(0, 1, 500), rng.normal(40, 0.01, 40), [500.0]])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),)], "v double")
    got = sorted(map(tuple, profile.density_curve(df, "v", 300).collect()))
    width = v.std(ddof=1) * len(v) ** -0.2
    grid = np.linspace(v.min(), v.max(), 300)
    want = np.exp(-0.5 * ((grid[:, None] - v) / width) ** 2).sum(1) / (len(v) * width * (2 * np.pi) ** 0.5)
    assert [g[0] for g in got] == list(range(300))
    assert np.allclose([g[1] for g in got], grid) and np.allclose([g[2] for g in got], want, rtol=1e-9, atol=1e-15)
