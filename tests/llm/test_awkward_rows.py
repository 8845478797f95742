"""Every operator and stage on NULLs, empty and very long texts, ties, repeated rows, clashing columns and no rows."""

import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import pytest
from awkward_table import awkward_rows
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tallyframe.llm import bpe, licenses, maxent, packing, quality_crf, quality_rules, sharding, simhash, token_files, winnowing  # noqa: E402
from tallyframe.llm.common import fold_of, scratch_path  # noqa: E402

ROWS = awkward_rows()
IDS = Counter(i for i, _ in ROWS)
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def ids_of(rows, name="id"):
    return Counter(r[name] for r in rows)


def test_license_scan(awkward, empty):
    rows = licenses.scan_licenses(awkward, "doc_id", "text").collect()
    assert ids_of(rows) == IDS
    eight = [r for r in rows if r.id == 8]
    assert len(eight) == 2 and eight[0] == eight[1]
    assert (eight[0].n_base, eight[0].first_word, eight[0].last_word, eight[0].base_labels) == (3, 0, 4, "cc-by,gpl")
    seven = {r.labels for r in rows if r.id == 7}
    assert seven == {"", "mit,reserved"}
    assert all(r.n_words == 0 and r.labels == "" and r.score == 0 for r in rows if r.id in (3, 4, 5))
    assert licenses.scan_licenses(empty, "doc_id", "text").count() == 0


def test_license_notice_with_changed_words(frame):
    notice = " ".join(licenses.TEMPLATES[4].words)
    words = notice.split()
    changed = " ".join([*words[:9], "any", "new", *words[9:15], *words[16:]])  # words put in and one left out
    half = " ".join(words[: len(words) // 2])
    rows = {r.id: r for r in licenses.scan_licenses(frame([(1, "x " + changed), (2, half), (3, notice.upper())]), "doc_id", "text").collect()}
    assert rows[1].labels == "mit" and 0.75 <= rows[1].score < 1
    assert rows[2].labels == ""
    assert rows[3].labels == "mit" and rows[3].score == 1.0


@pytest.mark.parametrize("more", [4, 6, 10])
def test_license_notice_with_many_words_put_in(frame, more):
    words = list(licenses.TEMPLATES[4].words)
    changed = [*words[:14], *[f"holder{i}" for i in range(more)], *words[14:]]
    apart = [*words[:14], *[f"prose{i}" for i in range(200)], *words[14:]]  # two halves are no notice
    rows = {r.id: r for r in licenses.scan_licenses(frame([(1, " ".join(changed)), (2, " ".join(apart))]), "doc_id", "text").collect()}
    assert rows[1].labels == "mit" and rows[1].score == 1.0
    assert rows[2].labels == ""


def test_long_labelled_documents_train(spark, frame):
    good, bad = "A calm sentence that says something useful.", "### $$$ ||| *** 111 222"
    few = [(i, "\n".join([good if i % 2 else bad] * 5)) for i in range(1, 40)]
    long = [(i, "\n".join(["CLICK NOW free free free" if i % 2 else good] * 250)) for i in range(100, 140)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in few] + [(i, (i + 1) % 2, 0) for i, _ in long], "doc_id long, quality int, toxic int")
    with_long = quality_crf.train(frame(few + long), labels, "doc_id", "text")
    without = quality_crf.train(frame(few), labels, "doc_id", "text")
    text = "CLICK NOW free free free\nCLICK NOW free free free"
    assert with_long != without and quality_crf.score(text, with_long) < quality_crf.score(text, without)


def test_texts_with_added_tokens(spark, frame):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>plain<|endoftext|>", "<|ENDOFTEXT|> x", "no such token", "<| half"]
    name = public_tokenizers.path("word_bpe_49k.json")
    path, library = scratch_path(spark, "tokens"), Tokenizer.from_file(name)
    token_files.write_tokens(frame(list(enumerate(texts))), "doc_id", "text", path, name, 2)
    got = {r.id: bytes(r.tokens) for r in token_files.read_tokens(spark, path).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert got[i] == b"".join(n.to_bytes(4, "little") for n in ids)


def test_byte_bpe(awkward, empty):
    ids = bpe.encoded(F.col("text"), PATH, PATTERN)
    rows = awkward.select("doc_id", "text", ids.alias("ids")).select("doc_id", "text", "ids", bpe.decoded(F.col("ids"), PATH, PATTERN).alias("back"))
    got = rows.collect()
    assert ids_of(got, "doc_id") == IDS
    assert all(bytes(r.back) == (r.text or "").encode() for r in got)
    assert empty.select(ids).count() == 0


def test_token_files(spark, awkward, empty):
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(awkward, "doc_id", "text", path, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert ids_of(rows) == IDS
    numbers = [r.id for r in rows]
    assert numbers == sorted(numbers, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in rows:
        assert r.start == at and len(r.tokens) == 4 * r.n_tokens and bytes(r.tokens)[-4:] == b"\x02\0\0\0"
        at += r.n_tokens
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(empty, "doc_id", "text", path, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_quality_crf(spark, awkward, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (3, None, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for docs, marks in ((awkward, labels), (awkward, labels.limit(0)), (empty, labels)):
        model = quality_crf.train(docs, marks, "doc_id", "text")
        rows = awkward.select("doc_id", quality_crf.quality(F.col("text"), model).alias("s")).collect()
        assert ids_of(rows, "doc_id") == IDS and all(0 <= r.s <= 1 for r in rows)
    assert empty.select(quality_crf.quality(F.col("text"), model)).count() == 0


def test_simhash(awkward, empty):
    rows = simhash.near_groups(awkward, "doc_id", "text").collect()
    assert ids_of(rows) == IDS
    component = {r.id: r.component for r in rows if r.id not in (None, 7)}
    assert component[2] == 1 and component[4] == component[5] == 3
    assert {r.component for r in rows if r.id is None} >= {3}  # the NULL text joins the empty ones
    kept = simhash.drop_near_copies(awkward, "doc_id", "text")
    assert kept.columns == awkward.columns
    assert kept.count() == len({r.group for r in rows})
    assert simhash.near_groups(empty, "doc_id", "text").count() == 0
    assert simhash.drop_near_copies(empty, "doc_id", "text").count() == 0


def test_winnowing(awkward, empty, frame):
    rows = winnowing.edit_likeness(awkward, "doc_id", "text").collect()
    assert ids_of(rows) == IDS
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    alike = [r.fingerprint for r in rows if r.id in (1, 2)]
    assert alike[0] == alike[1] != ""
    one = winnowing.edit_likeness(frame([(1, "abcdef")]), "doc_id", "text").first()
    assert (one.n_chars, one.near_next) == (6, 1.0)
    assert winnowing.edit_likeness(empty, "doc_id", "text").count() == 0
    marks = {r.doc_id: r.m for r in awkward.select("doc_id", winnowing.winnowed(F.col("text")).alias("m")).collect()}
    assert marks[3] == [] and all(m.position >= 0 for m in marks[6])


def test_quality_rules(awkward, empty):
    rows = quality_rules.judge(awkward, "text", "length").collect()  # replaces a column
    assert ids_of(rows, "doc_id") == IDS
    for r in rows:
        assert r.length.base_failed or r.length.n_words >= 50
        assert not r.length.kept or not r.length.base_failed
    assert {r.length.kept for r in rows if r.doc_id in (1, 2)} == {True}
    assert {r.length.kept for r in rows if r.doc_id in (3, 4, 5)} == {False}
    assert quality_rules.judge(empty, "text", "verdict").count() == 0


def test_sharding(awkward, empty):
    rows = sharding.shuffle_into_shards(awkward, "doc_id", "text", shards=5).collect()
    assert ids_of(rows) == IDS
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 5, p // 5) for p in range(len(ROWS)))
    again = sharding.shuffle_into_shards(awkward.repartition(2), "doc_id", "text", shards=5).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    assert sharding.shuffle_into_shards(empty, "doc_id", "text").count() == 0


def test_packing(awkward, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = packing.pack(awkward, "doc_id", "text", path, capacity=64).collect()
    assert Counter(r.id for r in rows if r.piece == 0) == IDS
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, "doc_id", "text", path).count() == 0


def test_lm_scoring(awkward, empty):
    rows = maxent.score_texts(awkward, "doc_id", "text", fold_of("doc_id") != 1).collect()
    assert ids_of(rows) == IDS
    assert all(r.n_tokens >= 1 and r.base_score <= 0 and r.score < 0 for r in rows)
    assert maxent.score_texts(empty, "doc_id", "text", F.lit(True)).count() == 0
    untrained = maxent.score_texts(awkward, "doc_id", "text", F.lit(False)).collect()
    assert ids_of(untrained) == IDS and all(r.n_known == 0 and r.train_tokens == 0 for r in untrained)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["awkward", "empty"])
def test_pipeline_stages(spark, frame, empty, tmp_path, rows):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(rows) if rows else empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
        docs = kept
    left = {r.doc_id for r in docs.collect()}
    assert 2 not in left and 3 not in left
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()} == left
