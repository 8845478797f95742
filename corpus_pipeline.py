"""A pipeline over the documents: classify, judge, remove near-duplicates, pack.

Each stage takes (spark, docs, sf_dir) and gets what its predecessor kept, written
as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, materialise
from tallyframe.llm.quality_crf import quality, train
from tallyframe.llm.quality_rules import judge
from tallyframe.llm.queries import ACCEPT_FROM, packed
from tallyframe.llm.simhash import drop_near_copies


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, trained on the labelled ones among them, does not reject."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text")
    return docs.where(quality(F.col("text"), model) >= ACCEPT_FROM)


def judge_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules keep."""
    verdict = fresh("verdict")
    return judge(docs, "text", verdict).where(F.col(f"{verdict}.kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return drop_near_copies(docs, "doc_id", "text", shingle=3, bits=2).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A place in a sequence for every piece of every document."""
    return packed(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", judge_rules),
    ("simhash_near_dedup", near_dedup),
    ("best_fit_packing", pack_sequences),
]

# SQL can express neither the trained model, the components nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
