"""Run registered queries against DuckDB: python tests/oracle_check.py [sf dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyframe.plans import registry  # noqa: E402
import tallyframe.plans  # noqa: E402,F401


def connect(directory: str):
    con = duckdb.connect()
    for name in registry.TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([_plain(v) for v in value])
    return repr(value)


def compare(spark, con, name: str, directory: str) -> str:
    """'' when equal, otherwise what differs."""
    plan = registry.PLANS[name]
    df = registry.callables()[name](spark, directory)
    got = [tuple(r) for r in df.collect()]
    if plan.sql is None:
        return "" if got else "no rows"
    cur = con.execute(plan.sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if not got and not expected:
        return "both empty"
    order = [df.columns.index(c) for c in columns]
    a = sorted(tuple(_plain(r[i]) for i in order) for r in got)
    b = sorted(tuple(_plain(v) for v in r) for r in expected)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)}/{len(a)} rows differ, e.g. {wrong[0]} ({df.schema.simpleString()})"[:900] if wrong else ""


def main() -> int:
    from tallyframe.session import build_session

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.PLANS)
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="8g",
        spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir="/tmp/tallyframe-warehouse",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, name, directory)
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{time.time() - start:6.2f}s {name} {problem}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
