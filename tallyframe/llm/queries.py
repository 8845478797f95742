"""The registered queries: thin calls of the operators with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.bpe import decoded, encoded
from tallyframe.llm.common import documents, fold_of, materialise, scratch_path, text_of
from tallyframe.llm.licenses import scan_licenses
from tallyframe.llm.long_matches import drop_long_matches
from tallyframe.llm.maxent import score_texts
from tallyframe.llm.packing import pack
from tallyframe.llm.quality_crf import quality, train
from tallyframe.llm.quality_rules import judge
from tallyframe.llm.sharding import shuffle_into_shards
from tallyframe.llm.simhash import near_groups
from tallyframe.llm.simplex_clusters import centroid_digest, cluster_vectors
from tallyframe.llm.token_files import read_tokens, write_tokens
from tallyframe.llm.vector_codes import code_vectors, codebook_digest
from tallyframe.llm.vectors import LONGEST
from tallyframe.llm.winnowing import edit_likeness

RANKS = "byte_bpe_50k.tiktoken"
WORDS, BYTES = "word_bpe_49k.json", "byte_bpe_50k.json"
END_ID = 2
CAPACITY = 1024  # tokens of a packed sequence
ACCEPT_FROM = 0.3  # score from which a document counts as good
SHARDS = 16


def op1_license_scans(spark: SparkSession, directory: str) -> DataFrame:
    found = scan_licenses(documents(spark, directory), "doc_id", "text")
    return found.withColumnRenamed("id", "doc_id")


def op2_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = documents(spark, directory).select("doc_id", encoded(text_of("text"), path, pattern).alias("ids"))
    return ids.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), path, pattern), 256).alias("decoded_sha256"),
    )


def op3_token_files(spark: SparkSession, directory: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(documents(spark, directory), "doc_id", "text", path, public_tokenizers.path(WORDS), END_ID)
    return read_tokens(spark, path).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("tokens").alias("ids_crc32")
    )


def op4_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    model = train(docs, spark.read.parquet(f"{directory}/labels.parquet"), "doc_id", "text")
    scored = docs.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), quality(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= ACCEPT_FROM).cast("int"))


def op5_simhash(spark: SparkSession, directory: str) -> DataFrame:
    groups = near_groups(documents(spark, directory), "doc_id", "text", shingle=3, bits=2)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op6_winnowing(spark: SparkSession, directory: str) -> DataFrame:
    return edit_likeness(documents(spark, directory), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op7_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    judged = judge(documents(spark, directory).select("doc_id", "text"), "text", "verdict")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[f"verdict.{c}" for c in [*counts, "base_failed", "kept", "probability"]])


def op8_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = shuffle_into_shards(documents(spark, directory), "doc_id", "text", SHARDS)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packed(documents(spark, directory))


def packed(docs: DataFrame) -> DataFrame:
    return pack(docs, "doc_id", "text", public_tokenizers.path(BYTES), CAPACITY, END_ID).withColumnRenamed("id", "doc_id")


def op10_lm_scoring(spark: SparkSession, directory: str) -> DataFrame:
    scored = score_texts(documents(spark, directory), "doc_id", "text", fold_of("doc_id") != 1)
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", ~F.col("training")).drop("training")


def _capped(total: str) -> Column:
    return F.least(F.sum(F.col(total).cast("decimal(38,0)")), F.lit(LONGEST)).cast("bigint")


def op11_vector_codes(spark: SparkSession, directory: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{directory}/embeddings.parquet")
    coded, books = code_vectors(embeddings, "vec_id", "embedding", "label", parts=8, entries=16, rounds=6, scale=4096)
    totals = materialise(coded.groupBy(F.col("label").alias("of")).agg(_capped("error").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"),
    )


def op12_simplex_clusters(spark: SparkSession, directory: str) -> DataFrame:
    embeddings = spark.read.parquet(f"{directory}/embeddings.parquet")
    placed, centroids = cluster_vectors(embeddings, "vec_id", "embedding", clusters=16, rounds=3, length=64, scale=64)
    found = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum")).collect()  # a row a cluster
    inertia = min(sum(int(r["sum"]) for r in found), LONGEST)
    rows = [(r["cluster"], min(int(r["sum"]), LONGEST), inertia, centroid_digest(centroids[r["cluster"]])) for r in found]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def op13_long_matches(spark: SparkSession, directory: str) -> DataFrame:
    cut = drop_long_matches(documents(spark, directory), "doc_id", "text", length=200)
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, run: total + run["end"] - run["start"])
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scans,
        op2_byte_bpe,
        op3_token_files,
        op4_quality_classifier,
        op5_simhash,
        op6_winnowing,
        op7_quality_rules,
        op8_sharding,
        op9_packing,
        op10_lm_scoring,
        op11_vector_codes,
        op12_simplex_clusters,
        op13_long_matches,
    )
}

# SQL cannot express voting, tokenizers, trained models, components or permutations;
# tests hold these queries against brute force, the libraries or held-out labels.
ORACLE_SQL: dict[str, str] = {}
