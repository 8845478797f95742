"""The registered text queries on the smallest table, against brute force and the libraries."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from tallyframe.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def run(spark, name):
    return {r["doc_id"]: r for r in QUERIES[name](spark, SMALL).collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    def load(name):
        tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids

    return load


def test_license_scans(spark, texts):
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    got = run(spark, "op1_license_scans")
    assert set(got) == set(texts)
    for number, text in texts.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text))
        places = [(i, l) for p, l in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        row = got[number]
        assert (row.n_words, row.n_base) == (len(words), len(places))
        assert (row.first_word, row.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert row.base_labels == ",".join(sorted({l for _, l in places}))
        assert set(filter(None, row.base_labels.split(","))) <= set(filter(None, row.labels.split(",")))
        assert 0 <= row.score <= 1


def test_byte_bpe_is_tiktoken(spark, texts):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for number, row in run(spark, "op2_byte_bpe").items():
        ids = coder.encode_ordinary(texts[number] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((texts[number] or "").encode()).hexdigest()


def test_token_files(spark, texts, library):
    encode, start = library("word_bpe_49k.json"), 0
    got = run(spark, "op3_token_files")
    assert set(got) == set(texts)
    for number in sorted(texts):
        ids = [*encode(texts[number]), 2]
        assert (got[number].start, got[number].n_tokens, got[number].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


def test_simhash(spark, texts):
    prints = {}
    for number, text in texts.items():
        words = WORD.findall(fold(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        ones = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
        prints[number] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    component = {n: n for n in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and component[b] < component[a]:
                    component[a], changed = component[b], True
    got = run(spark, "op5_simhash")
    assert {n: (r.fingerprint, r.component_id) for n, r in got.items()} == {n: (f"{prints[n]:016x}", component[n]) for n in prints}


def test_winnowing(spark, texts):
    from tallyframe.llm.winnowing import likeness, winnow, written

    order = sorted(texts, reverse=True)
    got = run(spark, "op6_winnowing")
    assert set(got) == set(texts)
    better = 0
    for here, following in zip(order, [*order[1:], order[0]], strict=True):
        text, then, row = texts[here], texts[following], got[here]
        third = len(text) // 3
        edited = text[: len(text) - third] + then[:third]
        kept, edited_kept = winnow(text)[0], winnow(edited)[0]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row.fingerprint, row.edited_fingerprint) == (written(kept), written(edited_kept))
        assert row.near_edited == likeness(kept, edited_kept) and row.near_next == likeness(kept, winnow(then)[0])
        better += row.near_edited > row.near_next
    assert better > 0.95 * len(order)


def test_quality_rules(spark, texts):
    for number, row in run(spark, "op7_quality_rules").items():
        text = texts[number] or ""
        words = WORD.findall(text)
        windows = list(zip(words, words[1:], words[2:], strict=False))
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (row.n_dup_lines, row.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert row.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row.base_failed and row.kept)


def test_sharding(spark, texts):
    rows = run(spark, "op8_sharding")
    assert set(rows) == set(texts)
    slots = {}
    for number, row in rows.items():
        data = (texts[number] or "").encode()
        assert (row["size"], row.text_crc32, row.law, row.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots.setdefault(row.shard, []).append(row.slot)
    assert set(slots) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_packing(spark, texts, library):
    encode = library("byte_bpe_50k.json")
    made = QUERIES["op9_packing"](spark, SMALL).collect()
    pieces, places = {}, {}
    for r in made:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(texts)
    total = 0
    for number, own in pieces.items():
        ids, at = [*encode(texts[number]), 2], 0
        total += len(ids)
        for piece in range(len(own)):
            r = own[piece]
            assert r.start == at and r.ids_crc32 == crc(ids[at : at + r.length])
            assert r.length == 1024 or piece == 0
            at += r.length
        assert at == len(ids)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= 1.05 * math.ceil(total / 1024)


def test_lm_scoring(spark, texts):
    split = {n: [*WORD.findall(fold(t)), "\n"] for n, t in texts.items()}
    held = {n: zlib.crc32(str(n).encode()) % 5 == 1 for n in texts}
    counts = Counter(w for n, ws in split.items() if not held[n] for w in ws)
    total, even = sum(counts.values()), math.log10(sum(counts.values()) + 0.5 * (len(counts) + 1))
    better = 0
    for number, row in run(spark, "op10_lm_scoring").items():
        words = split[number]
        base = sum(math.log10(counts[w] + 0.5) - even for w in words)
        assert (row.held_out, row.n_tokens, row.train_tokens) == (held[number], len(words), total)
        assert row.n_known == sum(counts[w] > 0 for w in words)
        assert math.isclose(row.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
        assert row.score < 0
        better += row.score > row.base_score
    assert better > 0.6 * len(texts)


def test_quality_classifier(spark, texts):
    got = run(spark, "op4_quality_classifier")
    assert set(got) == set(texts)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for number, row in got.items():
        assert row.held_out == (zlib.crc32(str(number).encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
    right = [got[n].predicted == q for n, q in labels.items() if got[n].held_out]
    assert sum(right) >= 0.85 * len(right)
