"""Registration of named queries with their SQL counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def fresh_name(label: str) -> str:
    """A table or view name that is nobody else's."""
    return f"{label}_{uuid.uuid4().hex[:12]}"


class Tables:
    """Attribute access to the Parquet tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @contextmanager
    def views(self, *tables: str):
        """Map from table to a view of it under a fresh name; the views are gone after the block."""
        names = {name: fresh_name(name) for name in tables or TABLE_NAMES}
        try:
            for name, view in names.items():
                getattr(self, name).createOrReplaceTempView(view)
            yield names
        finally:
            for view in names.values():
                self.spark.catalog.dropTempView(view)


@dataclass(frozen=True)
class Plan:
    name: str
    ids: str
    build: Callable[[Tables], DataFrame]
    sql: str | None


PLANS: dict[str, Plan] = {}


def plan(name: str, ids: str, sql: str | None = None):
    """Register ``build(tables)`` under ``name`` with the inventory ids it covers."""

    def wrap(build):
        if name in PLANS:
            raise ValueError(f"query {name!r} registered twice")
        PLANS[name] = Plan(name, ids, build, sql)
        return build

    return wrap


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, directory, build=p.build: build(Tables(spark, directory))) for name, p in PLANS.items()
    }


def statements() -> dict[str, str]:
    return {name: p.sql for name, p in PLANS.items() if p.sql}
