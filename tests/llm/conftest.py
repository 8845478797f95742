import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from awkward_table import awkward_rows  # noqa: E402

ROOT = Path(__file__).resolve().parents[2]
# Python workers import the package, whatever folder the tests start in.
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH", "")]))

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use inside or return
        *[T.StructField(n, T.StringType()) for n in ("id", "key", "hash", "fingerprint", "part", "score", "row", "words", "length")],
    ]
)
SMALL = "/root/testdata/sf0.001"
@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["clash"] * 9) for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def awkward(frame):
    return frame(awkward_rows())


@pytest.fixture(scope="session")
def empty(frame, spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(spark):
    """doc_id to text of the smallest documents table."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
