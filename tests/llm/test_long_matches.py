"""Removal of long repeated strings against a plain count of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from awkward_table import awkward_rows

from tallyframe.llm import long_matches, queries
from tallyframe.llm.run_index import END, RunIndex

SMALL = "/root/testdata/sf0.001"


def plain_spans(texts, length):
    """Per text the maximal runs of bytes covered by a string of the length that starts twice anywhere."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        runs, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            at = gone.find(0, start)
            at = len(t) if at < 0 else at
            runs.append((start, at))
        out.append(runs)
    return out


def check(rows, got, length=200):
    texts = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), text, runs in zip(rows, texts, plain_spans(texts, length), strict=True):
        edges = [0, *[x for r in runs for x in r], len(text)]
        expected.append((i, len(text), runs, b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
    found = [(r.id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def plain_statistics(texts):
    places = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]

    def shared(a, b):
        n = 0
        for x, y in zip(texts[a[0]][a[1] :], texts[b[0]][b[1] :], strict=False):
            if x != y:
                break
            n += 1
        return n

    return {p: max((shared(p, q) for q in places if q != p), default=0) for p in places}


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    letters = b"ab" if seed % 2 else b"abcdefgh"
    base = bytes(rng.choices(letters, k=60))
    texts = [base[rng.randrange(20) : rng.randrange(30, 60)] + bytes(rng.choices(letters, k=rng.randrange(8))) for _ in range(9)]
    texts += [b"", b"a", b"a" * 40, texts[0]]
    index = RunIndex(texts)
    found = index.matching_statistics()
    for (t, i), n in plain_statistics(texts).items():
        assert found[index.starts[t] + i] == n
    assert int(index.run_lengths.sum()) == index.size == sum(map(len, texts)) + len(texts)
    written = Counter()
    for b, n in zip(index.run_bytes.tolist(), index.run_lengths.tolist(), strict=True):
        written[b] += n
    assert written == Counter(b"".join(texts)) + Counter({END: len(texts)})


def test_runs_stay_few_in_repetitive_texts():
    rng = random.Random(1)
    base = bytes(rng.choices(range(32, 127), k=400))
    once, often = RunIndex([base]), RunIndex([base[:i] + b"!" + base[i:] for i in range(0, 400, 10)])
    assert len(often.run_lengths) < 4 * len(once.run_lengths) < often.size / 8
    assert len(RunIndex([]).matching_statistics()) == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 101, 700).astype(np.uint8)
    texts = [passage, np.concatenate([rng.integers(97, 101, 333).astype(np.uint8), passage[100:500]]), np.full(900, 97, np.uint8), passage[:199]]
    ends = np.cumsum([len(t) for t in texts])
    starts = ends - [len(t) for t in texts]
    data = np.concatenate([*texts, np.zeros(40, np.uint8)])
    found, windows = {}, Counter()
    for text, key, place, least, largest in zip(*(c.tolist() for c in long_matches.anchors(data, starts, ends, 200)), strict=True):
        for offset in range(least, largest + 1):
            at = starts[text] + place - offset
            windows[text, place - offset] += 1
            assert found.setdefault(bytes(data[at : at + 200]), (key, offset)) == (key, offset)
    assert windows == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - 199))


def shared_passages(n=60):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(k)) for k in (30, 45, 60, 200)]
    texts = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 50)))]
        for _ in range(rng.randrange(3)):
            cut = rng.choice(passages)
            parts += [cut[rng.randrange(9) :], word()]
        texts.append(" ".join(parts))
    return [(i, t) for i, t in enumerate([*texts, *texts[:5], "=" * 5000, "é中" * 90, "é中" * 300, "ab" * 101 + "c"])]


@pytest.mark.parametrize("group", [long_matches.GROUP, 1, 2], ids=["whole", "divided", "halved"])
def test_shared_passages(frame, monkeypatch, group):
    monkeypatch.setattr(long_matches, "GROUP", group)
    monkeypatch.setattr(long_matches, "BUCKET_BYTES", 20_000)
    rows = shared_passages()
    check(rows, long_matches.drop_long_matches(frame(rows), "doc_id", "text").collect())


def test_other_lengths(frame):
    rows = shared_passages(20)
    for length in (33, 64, 287):
        check(rows, long_matches.drop_long_matches(frame(rows), "doc_id", "text", length).collect(), length)


def test_odd_rows(awkward, empty):
    check(awkward_rows(), long_matches.drop_long_matches(awkward, "doc_id", "text").collect())
    assert long_matches.drop_long_matches(empty, "doc_id", "text").count() == 0


def test_query(spark, texts):
    ids = list(texts)
    whole = [(texts[i] or "").encode() for i in ids]
    got = {r.doc_id: tuple(r) for r in queries.op13_long_matches(spark, SMALL).collect()}
    assert len(got) == len(ids)
    for i, text, runs in zip(ids, whole, plain_spans(whole, 200), strict=True):
        edges = [0, *[x for r in runs for x in r], len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        assert got[i] == (i, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())
