"""Declared constraints as a catalog, and one audit for all of them.

A constraint is declared, listed and checked; nothing is enforced on write. The audit
turns every row into entries (constraint, key), so a table is scanned once whatever
number of constraints it takes part in, and one aggregation with partial sums decides
them all: a key held by a third of all rows arrives as one entry per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the rules and of the actions of a foreign key.
NOT_NULL, UNIQUE, PRIMARY_KEY, FOREIGN_KEY, CHECK = "NOT NULL", "UNIQUE", "PRIMARY KEY", "FOREIGN KEY", "CHECK"
ACTIONS = ("RESTRICT", "CASCADE", "SET NULL", "NO ACTION")
LISTING = "constraint_name string, table_name string, rule string, columns string, referenced_table string, referenced_columns string, on_delete string, on_update string, expression string"


@dataclass(frozen=True)
class Constraint:
    """One rule over a table; use the functions below to make one."""

    name: str
    table: str
    rule: str
    columns: tuple[str, ...] = ()
    parent: str | None = None
    parent_columns: tuple[str, ...] = ()
    on_delete: str | None = None
    on_update: str | None = None
    expression: str | None = None


def not_null(table: str, column: str, name: str | None = None) -> Constraint:
    return Constraint(name or f"nn_{table}_{column}", table, NOT_NULL, (column,))


def unique(table: str, *columns: str, name: str | None = None) -> Constraint:
    return Constraint(name or f"uq_{table}_{'_'.join(columns)}", table, UNIQUE, columns)


def primary_key(table: str, *columns: str, name: str | None = None) -> Constraint:
    return Constraint(name or f"pk_{table}", table, PRIMARY_KEY, columns)


def foreign_key(
    table: str, columns: Sequence[str], parent: str, parent_columns: Sequence[str], on_delete: str = "RESTRICT", on_update: str = "CASCADE", name: str | None = None
) -> Constraint:
    if len(columns) != len(parent_columns):
        raise ValueError("a foreign key needs as many columns as its parent's key")
    if on_delete not in ACTIONS or on_update not in ACTIONS:
        raise ValueError(f"actions are {', '.join(ACTIONS)}")
    name = name or f"fk_{table}_{'_'.join(columns)}"
    return Constraint(name, table, FOREIGN_KEY, tuple(columns), parent, tuple(parent_columns), on_delete, on_update)


def check(table: str, expression: str, name: str) -> Constraint:
    return Constraint(name, table, CHECK, expression=expression)


def listing(spark: SparkSession, constraints: Sequence[Constraint]) -> DataFrame:
    """One row per declared constraint; names must differ."""
    names = [c.name for c in constraints]
    if len(set(names)) < len(names):
        raise ValueError(f"constraint names repeat: {sorted({n for n in names if names.count(n) > 1})}")
    joined = lambda columns: ", ".join(columns) or None
    rows = [(c.name, c.table, c.rule, joined(c.columns), c.parent, joined(c.parent_columns), c.on_delete, c.on_update, c.expression) for c in constraints]
    return spark.createDataFrame(rows, LISTING)


def _entry(number: int, key: Column, child: bool, broken: Column) -> Column:
    return F.struct(F.lit(number).alias("number"), key.alias("key"), F.lit(int(child)).alias("child"), F.lit(int(not child)).alias("parent"), broken.cast("int").alias("broken"))


def _key(columns: Sequence[str]) -> Column:
    """The key as text, or NULL where a part is missing; whole numbers of any width read alike."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return F.when(whole, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])))


def audit(tables: Mapping[str, DataFrame], constraints: Sequence[Constraint]) -> DataFrame:
    """(constraint_name, table_name, rule, violations) of every constraint.

    Violations count rows for NOT NULL, CHECK and FOREIGN KEY, surplus rows beyond the
    first of a key for UNIQUE, and both surplus rows and rows with a NULL in the key for
    PRIMARY KEY. A unique key or a foreign key that holds a NULL passes, and so does a
    check that is unknown.
    """
    missing = {t for c in constraints for t in (c.table, c.parent) if t} - set(tables)
    if missing:
        raise ValueError(f"no table {', '.join(sorted(missing))}")
    spark = next(iter(tables.values())).sparkSession
    entries: dict[str, list[Column]] = {}
    no_key, fine, broken = F.lit(None).cast("string"), F.lit(False), F.lit(True)
    for number, c in enumerate(constraints):
        own = entries.setdefault(c.table, [])
        if c.rule == NOT_NULL:
            own.append(F.when(F.col(c.columns[0]).isNull(), _entry(number, no_key, True, broken)))
        elif c.rule == CHECK:
            own.append(F.when(~F.expr(c.expression), _entry(number, no_key, True, broken)))
        else:
            key = _key(c.columns)
            absent = F.when(F.lit(c.rule == PRIMARY_KEY), _entry(number, no_key, True, broken))
            own.append(F.when(key.isNotNull(), _entry(number, key, True, fine)).otherwise(absent))
        if c.rule == FOREIGN_KEY:
            parent = _key(c.parent_columns)
            entries.setdefault(c.parent, []).append(F.when(parent.isNotNull(), _entry(number, parent, False, fine)))
    if not entries:
        return spark.createDataFrame([], "constraint_name string, table_name string, rule string, violations bigint")
    scans = [
        tables[t].select(F.explode(F.filter(F.array(*made), lambda e: e.isNotNull())).alias("e")).select("e.*") for t, made in entries.items()
    ]
    by_key = reduce(DataFrame.unionByName, scans).groupBy("number", "key").agg(*[F.sum(c).alias(c) for c in ("child", "parent", "broken")])
    rule = F.element_at(F.array(*[F.lit(c.rule) for c in constraints]), F.col("number") + 1)
    wrong = F.when(F.col("key").isNull(), F.col("broken")).when(rule == FOREIGN_KEY, F.when(F.col("parent") == 0, F.col("child"))).otherwise(F.col("child") - 1)
    counted = by_key.groupBy("number").agg(F.sum(F.coalesce(wrong, F.lit(0))).alias("violations"))
    names = [(i, c.name, c.table, c.rule) for i, c in enumerate(constraints)]
    listed = spark.createDataFrame(names, "number int, constraint_name string, table_name string, rule string")
    return listed.join(counted, "number", "left").select("constraint_name", "table_name", "rule", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))
