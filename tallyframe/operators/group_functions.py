"""A caller's own function over groups, with partial states.

``groupBy().applyInPandas`` brings a whole group to one task. Here the function is given
as init, update, merge and finish: rows are dealt by group and sorted, every task folds
its rows into one state per group and hands the states on. Spark deals a group that
outgrows a partition to several tasks, so one that holds a third of all rows arrives as
a few states, and a call of the function gets all rows of a group that its batch holds.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

STATES = 10_000  # states a task holds before it hands them on


def fold_groups(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    init: Callable[[], Any],
    update: Callable[[Any, pd.DataFrame], Any],
    merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], dict],
    schema: str,
) -> DataFrame:
    """One row per group: the ``by`` columns and what ``finish`` gives, with the types of ``schema``.

    ``update(state, rows)`` gets rows of one group as a pandas frame of ``columns``, in
    batches of any size and order; ``merge`` joins two states, so the result must not
    depend on how the rows were split. NULL is a group like any other. An empty table
    gives no rows.
    """
    by, columns = list(by), list(columns)
    if set(by) & set(columns):
        raise ValueError("group columns cannot be values too")
    keys = [f"__k{i}" for i in range(len(by))]
    key_fields = [T.StructField(k, df.schema[c].dataType) for k, c in zip(keys, by, strict=True)]
    made = T.StructType.fromDDL(schema)
    rows = df.select(*by, *columns)
    if by:
        # adaptive execution splits the partitions that a large group fills
        rows = rows.hint("rebalance", *by).sortWithinPartitions(*by)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        shown: dict[tuple, tuple] = {}
        types: list[pa.DataType] = []

        def handed() -> pa.RecordBatch:
            held = [pa.array([shown[k][i] for k in states], t) for i, t in enumerate(types)]
            packed = pa.array([pickle.dumps(s) for s in states.values()], pa.binary())
            batch = pa.RecordBatch.from_arrays([*held, packed], names=[*keys, "__state"])
            states.clear()
            shown.clear()
            return batch

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(len(by))]
            parts = [batch.column(i).to_pylist() for i in range(len(by))]
            values = pa.Table.from_batches([batch]).select(columns).to_pandas()
            start = 0
            for key, run in groupby(zip(*parts, strict=True), lambda row: tuple(map(repr, row))):
                end = start + sum(1 for _ in run)
                if key not in states:
                    if len(states) >= STATES:
                        yield handed()
                    states[key], shown[key] = init(), tuple(p[start] for p in parts)
                states[key] = update(states[key], values.iloc[start:end])
                start = end
        if states:
            yield handed()

    partial = rows.mapInArrow(fold, T.StructType([*key_fields, T.StructField("__state", T.BinaryType())]))

    def close(table: pa.Table) -> pa.Table:
        state = None
        for packed in table["__state"]:
            other = pickle.loads(packed.as_py())
            state = other if state is None else merge(state, other)
        result = finish(state)
        own = [table[k].slice(0, 1).combine_chunks() for k in keys]
        return pa.table([*own, *[pa.array([result[f.name]], t) for f, t in zip(made.fields, _arrow(made), strict=True)]], names=[*keys, *made.names])

    closed = partial.groupBy(*keys).applyInArrow(close, T.StructType([*key_fields, *made.fields]))
    return closed.withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema.fields]
