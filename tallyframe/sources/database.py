"""Database tables over JDBC, read in parallel ranges."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession

# JDBC URL shape per supported backend.
JDBC_URLS = {"mysql": "jdbc:mysql://{host}:{port}/{database}"}


def jdbc_options(backend: str, settings: Mapping[str, str]) -> dict[str, str]:
    """Reader options for ``backend``.

    ``settings`` needs host, port, database, table, user and password. With
    ``partition_column``, ``lower``, ``upper`` and ``partitions`` the table is
    read as that many parallel range queries.
    """
    if backend not in JDBC_URLS:
        raise ValueError(f"unknown backend {backend!r}; choose one of {sorted(JDBC_URLS)}")
    missing = [k for k in ("host", "port", "database", "table", "user", "password") if not settings.get(k)]
    if missing:
        raise ValueError(f"missing connection settings: {missing}")
    options = {
        "url": JDBC_URLS[backend].format(**settings),
        "dbtable": settings["table"],
        "user": settings["user"],
        "password": settings["password"],
        "fetchsize": settings.get("fetchsize", "10000"),
        "pushDownPredicate": "true",
    }
    if settings.get("partition_column"):
        options |= {
            "partitionColumn": settings["partition_column"],
            "lowerBound": settings["lower"],
            "upperBound": settings["upper"],
            "numPartitions": settings["partitions"],
        }
    return options


def settings_from_env(env: Mapping[str, str] | None = None) -> dict[str, str]:
    """Connection settings from DB_* variables; there are no default secrets."""
    env = os.environ if env is None else env
    keys = ("host", "port", "database", "table", "user", "password", "partition_column", "lower", "upper", "partitions")
    names = (
        "DB_HOST", "DB_PORT", "DB_NAME", "DB_TABLE", "DB_USER", "DB_PASSWORD",
        "DB_PARTITION_COLUMN", "DB_LOWER", "DB_UPPER", "DB_PARTITIONS",
    )
    return {key: env[name] for key, name in zip(keys, names) if name in env}


def load_table(
    spark: SparkSession,
    backend: str,
    settings: Mapping[str, str],
    row_filter: Column | None = None,
    reader: Callable[[SparkSession, dict[str, str]], DataFrame] | None = None,
) -> DataFrame:
    """Read a table, optionally filtered (the filter is pushed to the database).

    Unknown backends raise ``ValueError``; a failing read or an empty result
    raises ``RuntimeError``. ``reader`` replaces the JDBC read in tests.
    """
    options = jdbc_options(backend, settings)
    reader = reader or (lambda session, opts: session.read.format("jdbc").options(**opts).load())
    try:
        df = reader(spark, options)
        df = df if row_filter is None else df.filter(row_filter)
        empty = df.isEmpty()
    except Exception as error:
        raise RuntimeError(f"failed to load from {backend!r}: {error}") from error
    if empty:
        raise RuntimeError(f"no rows from {backend!r}: check the table name and the filter")
    return df


def write_table(df: DataFrame, backend: str, settings: Mapping[str, str], if_exists: str = "replace") -> None:
    """Write ``df`` to a database table; the modes are those of ``ingest_csv``."""
    from tallyframe.sources.files import INGEST_MODES

    options = jdbc_options(backend, settings)
    df.write.format("jdbc").options(**options).mode(INGEST_MODES[if_exists]).save()
