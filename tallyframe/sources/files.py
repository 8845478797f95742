"""CSV, text and Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What the reader calls an empty unquoted field, so that a quoted empty one stays a text.
NO_VALUE = "\x01no value\x01"

# How a load treats a target that already exists.
INGEST_MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = True) -> DataFrame:
    """CSV with a header line and a declared schema (nothing is inferred).

    Columns are found by their names in the header, in any order; quotes inside
    quotes are doubled, and quoted fields may hold line breaks. Empty fields are NULL,
    quoted empty ones empty texts. A field that does not
    fit its type, or a line that does not fit the header, fails the read. ``multi_line=False``
    lets a large file without quoted line breaks be split over tasks.
    """
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "mode": "FAILFAST", "nullValue": NO_VALUE}
    header = spark.read.options(**options).csv(path).columns
    missing = [f.name for f in wanted.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    types = {f.name: f.dataType for f in wanted.fields}
    in_file_order = T.StructType([T.StructField(name, types.get(name, T.StringType())) for name in header])
    return spark.read.schema(in_file_order).options(**options).csv(path).select(*wanted.names)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; quotes are doubled, blanks at the ends of a field stay, empty strings differ from NULLs."""
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": '""'}
    df.write.mode(mode).options(**options, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, surrounding blanks removed."""
    return spark.read.text(path).select(F.trim("value").alias("line"))


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    """Write one string column as text lines; ``mode`` is overwrite or append."""
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def copy_lines(spark: SparkSession, source: str, target: str) -> None:
    """Copy a text dataset line for line."""
    spark.read.text(source).write.mode("overwrite").text(target)


def ingest_csv(
    spark: SparkSession, csv_path: str, schema: T.StructType | str, target: str, if_exists: str = "replace"
) -> DataFrame:
    """Load a CSV into a Parquet dataset and return that dataset."""
    if if_exists not in INGEST_MODES:
        raise ValueError(f"if_exists must be one of {sorted(INGEST_MODES)}, got {if_exists!r}")
    read_csv(spark, csv_path, schema).write.mode(INGEST_MODES[if_exists]).parquet(target)
    return spark.read.parquet(target)
