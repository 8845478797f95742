"""SimHash near-duplicates through vantage-point trees over Hamming distance.

Equal fingerprints collapse first. A tree of vantage points built on a bounded
sample deals the distinct fingerprints to shards: a node sends those within its
radius inside and the others outside. By the triangle inequality a fingerprint
outside can only have a partner inside if its distance exceeds the radius by at
most the wanted number of bits, so just these visit the inner branch as queries.
Each shard goes on with a tree of its own and compares exactly in its leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, materialise, text_of
from tallyframe.operators.components import connected_components

SHARD_ROWS = 20_000  # distinct fingerprints a shard should hold
MAX_SHARDS = 65_536  # bounds the tree that every task gets
SAMPLE_PER_SHARD = 32  # sampled fingerprints per shard that place the vantage points
LEAF_ROWS = 512  # compared pair by pair
BLOCK = 4096
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text, repeats included."""
    words = text.encode().lower().split()  # bytes: only A-Z fold and only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
        n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        block = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Bigint column with the bits of ``fingerprint``; NULL counts as the empty text (zero)."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py() or "", shingle) for t in batch), np.uint64, len(batch))
            yield pa.array(bits.view(np.int64))

    return hashed(text)


class Node:
    __slots__ = ("vantage", "radius", "inside", "outside", "leaf")

    def __init__(self, leaf=None, vantage=None, radius=None, inside=None, outside=None):
        self.leaf, self.vantage, self.radius, self.inside, self.outside = leaf, vantage, radius, inside, outside


def _cut(values: np.ndarray, rng: np.random.Generator) -> tuple[np.uint64, int, np.ndarray] | None:
    """A vantage point with a radius that splits ``values``, and which of them lie within; None if none of a few does."""
    best = None
    for vantage in rng.choice(values, min(4, len(values)), replace=False):
        distance = np.bitwise_count(values ^ vantage)
        radius = int(np.median(distance))
        if radius == distance.max():
            radius -= 1
        within = distance <= radius
        held = int(within.sum())
        if 0 < held < len(values):
            near = int((np.abs(distance.astype(np.int64) - radius) <= 2).sum())
            score = near + abs(2 * held - len(values))
            if best is None or score < best[0]:
                best = (score, vantage, radius, within)
    return best and best[1:]


def build_tree(sample: np.ndarray, shards: int) -> tuple[Node, int]:
    """A tree with at most ``shards`` leaves, and their number."""
    rng = np.random.default_rng(SEED)
    made = 0

    def grow(values: np.ndarray, wanted: int) -> Node:
        nonlocal made
        split = _cut(values, rng) if wanted > 1 and len(values) > 1 else None
        if split is None:
            made += 1
            return Node(leaf=made - 1)
        vantage, radius, within = split
        left = min(wanted - 1, max(1, round(wanted * within.mean())))
        return Node(None, vantage, radius, grow(values[within], left), grow(values[~within], wanted - left))

    return grow(np.unique(sample), shards), made


def visits(values: np.ndarray, home: np.ndarray, query: np.ndarray, vantage, radius: int, bits: int):
    """Rows at home and rows querying in both branches of a node."""
    d = np.bitwise_count(values[home] ^ vantage).astype(np.int64)
    q = np.bitwise_count(values[query] ^ vantage).astype(np.int64)
    rim = home[(d > radius) & (d <= radius + bits)]
    inside = home[d <= radius], np.concatenate([query[q <= radius + bits], rim])
    outside = home[d > radius], query[q > radius - bits]
    return inside, outside


def route(values: np.ndarray, tree: Node, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, rows at home there, rows that query there)."""
    todo = [(tree, np.arange(len(values)), np.empty(0, np.int64))]
    while todo:
        node, home, query = todo.pop()
        if node.leaf is not None:
            if len(home) or len(query):
                yield node.leaf, home, query
            continue
        inside, outside = visits(values, home, query, node.vantage, node.radius, bits)
        todo += [(node.inside, *inside), (node.outside, *outside)]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the groups of each pair; root[i] is the smallest row of i's group."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def local_groups(values: np.ndarray, home: np.ndarray, query: np.ndarray, bits: int) -> np.ndarray:
    """For every row the smallest row it is linked to, through links that touch a row at home."""
    rng = np.random.default_rng(SEED)
    root = np.arange(len(values))
    todo = [(home, query)]
    while todo:
        home, query = todo.pop()
        if not len(home):
            continue
        split = _cut(values[home], rng) if len(home) > LEAF_ROWS else None
        if split is not None:
            inside, outside = visits(values, home, query, split[0], split[1], bits)
            if max(len(inside[0]) + len(inside[1]), len(outside[0]) + len(outside[1])) < len(home) + len(query):
                todo += [inside, outside]
                continue
        others = np.concatenate([home, query])
        for i in range(0, len(home), LEAF_ROWS):
            rows = home[i : i + LEAF_ROWS]
            for j in range(i, len(others), BLOCK):
                columns = others[j : j + BLOCK]
                near = np.bitwise_count(values[rows][:, None] ^ values[columns][None, :]) <= bits
                a, b = np.nonzero(near)
                root = _unite(root, rows[a], columns[b])
    return root


def near_groups(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, bits: int = 2, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(id, fingerprint bigint, group bigint, component): groups linked by fingerprints at most ``bits`` bits apart.

    group is one fingerprint of the group, component its smallest id. Every row is
    answered and has the columns ``carry`` besides, expressions over ``docs``; repeated rows and equal texts share a fingerprint. NULL
    and empty texts have fingerprint zero and are linked like any other. NULL ids are
    passed over when the smallest id is sought; a group without any id gets NULL. An
    empty table gives no rows. The result does not depend on the sample.
    """
    more = carry or {}
    found = fingerprints(F.col(f"`{text_col}`").cast("string"), shingle).alias("fingerprint")
    hashed = materialise(docs.select(F.col(f"`{id_col}`").alias("id"), found, *[c.alias(n) for n, c in more.items()]))
    distinct = materialise(hashed.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    total = distinct.count()
    shards = max(1, min(MAX_SHARDS, total // SHARD_ROWS))
    wanted = shards * SAMPLE_PER_SHARD
    sample = distinct.select("fingerprint").sample(min(1.0, 2 * wanted / max(total, 1)), seed=SEED).limit(4 * wanted)
    tree, _ = build_tree(sample.toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64), shards)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for leaf, home, query in route(values, tree, bits):
                rows = np.concatenate([home, query])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), leaf, np.int32)),
                        pa.array(values[rows].view(np.int64)),
                        pa.array(np.arange(len(rows)) < len(home)),
                    ],
                    names=["shard", "fingerprint", "home"],
                )

    def links(table: pa.Table) -> pa.Table:
        values = table["fingerprint"].to_numpy().view(np.uint64)
        at_home = table["home"].to_numpy()
        root = local_groups(values, np.flatnonzero(at_home), np.flatnonzero(~at_home), bits)
        linked = np.flatnonzero(root != np.arange(len(root)))
        signed = values.view(np.int64)
        return pa.table({"a": signed[linked], "b": signed[root[linked]]})

    dealt = distinct.select("fingerprint").mapInArrow(deal, "shard int, fingerprint bigint, home boolean")
    edges = materialise(dealt.groupBy("shard").applyInArrow(links, "a bigint, b bigint").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = materialise(connected_components(edges, nodes).withColumnRenamed("node", "fingerprint"))
    grouped = distinct.join(roots, "fingerprint").select("fingerprint", "root", "first_id")
    lowest = grouped.groupBy("root").agg(F.min("first_id").alias("lowest"))
    named = grouped.join(lowest, "root").select("fingerprint", "root", "lowest")
    labels = materialise(
        distinct.join(named, "fingerprint", "left").select(
            "fingerprint", F.coalesce("root", "fingerprint").alias("group"), F.coalesce("lowest", "first_id").alias("component")
        )
    )
    return hashed.join(labels, "fingerprint").select("id", "fingerprint", "group", "component", *more)


def drop_near_copies(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, bits: int = 2) -> DataFrame:
    """One row of each near-duplicate group, with all columns of ``docs``.

    The row with the smallest id stays, one without an id only where no row of the
    group has any; of rows equal in id and text one stays. Rows are recognised by two
    64-bit hashes of id and text.
    """
    first, second = fresh("key"), fresh("key")
    content = [F.col(f"`{id_col}`"), text_of(text_col)]
    keys = {first: F.xxhash64(F.lit(1), *content), second: F.xxhash64(F.lit(2), *content)}
    groups = near_groups(docs, id_col, text_col, shingle, bits, keys)
    chosen = groups.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", first, second)).alias("row"))
    keyed = docs.withColumns(keys).join(chosen.select(f"row.{first}", f"row.{second}"), [first, second], "left_semi")
    return keyed.dropDuplicates([first, second]).drop(first, second)
