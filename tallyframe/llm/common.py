"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise, scratch_path  # noqa: F401  (re-exported)


def fresh(label: str) -> str:
    """A column name that no caller's column can clash with."""
    return f"__{label}_{uuid.uuid4().hex[:8]}"


def text_of(name: str) -> Column:
    """The text column with NULL read as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fold_of(id_name: str, folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo ``folds``; a NULL id counts as the empty text."""
    written = F.coalesce(F.col(f"`{id_name}`").cast("string"), F.lit(""))
    return F.crc32(F.encode(written, "UTF-8")) % folds


def documents(spark, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/documents.parquet")
