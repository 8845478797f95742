"""Vector codes and centroid clusters against plain Python integers."""

import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from tallyframe.llm import queries, simplex_clusters, vector_codes

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id string, vector string, state string, cluster string, distance string, part string"


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def kept(rows):
    return [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    rows = kept(rows)
    length = -(-max((len(v) for _, v, _ in rows), default=0) // parts) * parts
    size = length // parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[int(Fraction(x) * scale // 1) for x in v] + [0] * (length - len(v)) for _, v, _ in rows]
    books, out = [], [["", 0] for _ in rows]
    for p in range(parts):
        values = [w[p * size : (p + 1) * size] for w in whole]
        book = [list(v) for v in values[:entries]]
        near = lambda v: min(range(len(book)), key=lambda e: (apart(v, book[e]), e))
        for _ in range(rounds):
            members = defaultdict(list)
            for v in values:
                members[near(v)].append(v)
            for e, held in members.items():
                book[e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
        for o, v in zip(out, values, strict=True):
            e = near(v)
            o[0] += f"{e:02x}"
            o[1] += apart(v, book[e])
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for row in b for x in row).encode()).hexdigest()
    return [(r[0], o[0], o[1], r[2]) for r, o in zip(rows, out, strict=True)], digest


def plain_clusters(rows, clusters=16, rounds=3, length=64, scale=64):
    rows = [r for r in kept(rows) if len(r[1]) == length]
    named = lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    rows = sorted(rows, key=named)
    values = [[int(Fraction(x) * scale // 1) for x in v] for _, v, _ in rows]
    centres = [list(v) for v in values[:clusters]]
    near = lambda v: min(range(len(centres)), key=lambda e: (apart(v, centres[e]), e))
    for _ in range(rounds):
        members = defaultdict(list)
        for v in values:
            members[near(v)].append(v)
        for e, held in members.items():
            centres[e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    found = [near(v) for v in values]
    return [(r[0], c, apart(v, centres[c])) for r, v, c in zip(rows, values, found, strict=True)], centres


def odd_rows(length, huge):
    random = np.random.default_rng(5)
    rows = [(i, random.normal(0, 1, length).round(2).tolist(), i % 3 or None) for i in range(60)]
    rows += [(i, rows[i % 7][1], 1) for i in range(60, 75)] + [(3, rows[3][1], None), (None, rows[4][1], 2)]  # ties, repeated rows
    rows += [(80, None, 1), (81, [None] + [0.5] * (length - 1), 1), (82, [float("nan")] * length, 1), (83, [float("inf")] * length, 1)]
    rows += [(84, [0.0] * length, 5), (85, [-0.0] * length, 5)]
    return rows + [(86, [huge] * length, 6), (-9, [-huge] + [1.0] * (length - 1), 6)] if huge else rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 6) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("huge", [0.0, 1e4, 3e38], ids=["small", "wide", "huge"])
def test_codes_of_odd_rows(spark, huge):
    rows = [*odd_rows(24, huge), (90, [], 7), (91, [1.0] * 5, 7)]  # empty and short vectors
    coded, books = vector_codes.code_vectors(frame(spark, rows), "vec_id", "embedding", "label")
    expected, digest = plain_codes(rows)
    capped = [(i, c, min(e, 2**63 - 1), label) for i, c, e, label in expected]
    got = [(r.id, bytes(r.code).hex(), r.error, r.label) for r in coded.collect()]
    assert sorted(got, key=repr) == sorted(capped, key=repr)
    assert vector_codes.codebook_digest(books) == digest


@pytest.mark.parametrize("huge", [0.0, 1e6, 1e300], ids=["small", "wide", "huge"])
def test_clusters_of_odd_rows(spark, huge):
    rows = [*odd_rows(64, huge), (90, [], 7), (91, [1.0] * 5, 7)]
    placed, centroids = simplex_clusters.cluster_vectors(frame(spark, rows), "vec_id", "embedding")
    expected, centres = plain_clusters(rows)
    got = [(r.id, r.cluster, r.distance) for r in placed.collect()]
    assert sorted(got, key=repr) == sorted([(i, c, min(d, 2**63 - 1)) for i, c, d in expected], key=repr)
    assert centroids.tolist() == centres


def test_few_and_no_rows(spark):
    for rows in ([], [(1, None, 1)], odd_rows(64, 0.0)[:3]):
        coded, _ = vector_codes.code_vectors(frame(spark, rows), "vec_id", "embedding", "label")
        assert sorted((r.id, bytes(r.code).hex(), r.error) for r in coded.collect()) == sorted(r[:3] for r in plain_codes(rows)[0])
        placed, _ = simplex_clusters.cluster_vectors(frame(spark, rows), "vec_id", "embedding")
        assert sorted(tuple(r) for r in placed.collect()) == sorted(plain_clusters(rows)[0])


def small_table(spark):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]


def test_query_of_codes(spark):
    expected, digest = plain_codes(small_table(spark))
    by_label = defaultdict(int)
    for _, _, error, label in expected:
        by_label[label] += error
    got = queries.op11_vector_codes(spark, SMALL).collect()
    assert got[0].__fields__ == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(tuple(r) for r in got) == sorted((i, c, e, by_label[label], digest) for i, c, e, label in expected)


def test_query_of_clusters(spark):
    expected, centres = plain_clusters(small_table(spark))
    by_cluster = defaultdict(int)
    for _, c, d in expected:
        by_cluster[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    got = queries.op12_simplex_clusters(spark, SMALL).collect()
    assert got[0].__fields__ == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(tuple(r) for r in got) == sorted((i, c, d, by_cluster[c], sum(by_cluster.values()), digest[c]) for i, c, d in expected)


def test_bounds_settle_most_parts_without_a_comparison():
    random = np.random.default_rng(1)
    centres = random.integers(-500, 500, (16, 8))
    values = centres[random.integers(0, 16, 2000)] + random.integers(-40, 40, (2000, 8))
    book = centres + random.integers(-5, 5, (16, 8))
    state = vector_codes.Bounds.unknown(2000, 4)
    assert (state.settle(values, book) == 16).all()
    state = vector_codes.Bounds.frombytes(np.frombuffer(b"".join(state.tobytes()), np.uint8).reshape(2000, -1), 4)
    state.moved(vector_codes.up(vector_codes.root(vector_codes.squared(centres, book))).astype(float))
    needed = state.settle(values, centres)
    plain = ((values[:, None] - centres) ** 2).sum(axis=2)
    assert (state.near[:, 0] == plain.argmin(axis=1)).all()
    assert (needed == 1).mean() > 0.8 and vector_codes._next_width(4, 16, 16, {1: 1999, 16: 1}) == 2
    assert (state.upper >= np.sqrt(plain.min(axis=1))).all()


def test_simplex_bounds_enclose_the_distances():
    random = np.random.default_rng(2)
    values = random.integers(-40, 40, (500, 64))
    base = simplex_clusters.Base(np.concatenate([values[:12], values[:1], values[:2] * 2 - values[1:3]]))
    others = random.integers(-40, 40, (20, 64))
    least, most = simplex_clusters.bounds(base.apexes(values), base.apexes(others))
    true = ((values[:, None] - others) ** 2).sum(axis=2)
    assert (least <= true).all() and (true <= most).all()
    assert len(base.pivots) >= 12
    near_pivots, compared = simplex_clusters.nearest(values, base.apexes(values), values[:8], base.apexes(values[:8]))
    assert (near_pivots == ((values[:, None] - values[:8]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert compared < 100  # distances to pivots are exact, so bounds alone decide
