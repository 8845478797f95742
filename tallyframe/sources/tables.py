"""Tables, snapshots, views and the catalog report."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.session import delete_stage, materialise, scratch_path


def inline_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(list(rows), schema)


def create_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace ``name`` by a table of the rows of ``df`` and return it.

    The rows are written to a fresh place before the old table is dropped, so a table
    can be rebuilt from itself and survives a failed write. ``path`` is the folder
    that holds the versions; by default they lie in the shared folder.
    """
    spark = df.sparkSession
    folder = f"{path.rstrip('/')}/{uuid.uuid4().hex}" if path else scratch_path(spark, "table")
    df.write.parquet(folder)
    drop_table(spark, name)
    spark.catalog.createTable(name, path=folder, source="parquet")
    return spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})


def create_snapshot(df: DataFrame, name: str) -> DataFrame:
    """A session-scoped table: rows are frozen in the shared folder now."""
    frozen = materialise(df)
    frozen.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def drop_snapshot(spark: SparkSession, name: str) -> bool:
    """Drop the view and delete its files; True if there was one."""
    if not spark.catalog.tableExists(name):
        return False
    files = spark.table(name).inputFiles()
    for folder in {f.rsplit("/", 1)[0] for f in files}:
        delete_stage(spark, folder)
    return spark.catalog.dropTempView(name)


def create_view(df: DataFrame, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A lazy view; with ``columns`` only those are visible through it."""
    (df.select(*columns) if columns else df).createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def table_columns(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """(table_name, position from 1, column_name, data_type, nullable) of each table, from the catalog alone."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name in names
        for i, f in enumerate(spark.table(name).schema.fields, 1)
    ]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string, nullable boolean")


def table_counts(spark: SparkSession, names: Iterable[str] | None = None, database: str | None = None) -> DataFrame:
    """Row count per table with the statement that yields it.

    Without ``names`` every table of ``database`` (default: the current one) is
    reported. The loop runs over table names only; counting is one Spark job.
    """
    if names is None:
        names = sorted(t.name for t in spark.catalog.listTables(database))
    counts = [
        spark.table(name).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"),
            F.lit(f"SELECT count(*) FROM {name}").alias("statement_text"),
            "row_count",
        )
        for name in names
    ]
    if not counts:
        raise ValueError("no tables to report")
    return reduce(DataFrame.unionByName, counts)
