"""Every registered query against its SQL in DuckDB on the smallest data."""

import pytest
from oracle_check import compare, connect

from tallyframe.plans import registry

DIRECTORY = "/root/testdata/sf0.001"
# Filters tuned for larger data may leave nothing here; both sides must agree on that.
MAY_BE_EMPTY = {"both empty"}


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(registry.PLANS))
def test_query(spark, duck, name):
    assert compare(spark, duck, name, DIRECTORY) in {"", *MAY_BE_EMPTY}


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    without = {n for n in set(entry.queries()) - set(entry.oracle_sql()) if n != "pipeline" and not n.startswith("op")}
    # each of these has an audit query with a counterpart
    assert without == {"random_scores", "kmeans_profile", "kmedoids", "bisecting", "elbow"}
