"""Token files: ids in document order, compressed by a Re-Pair grammar.

Rows of the file table are blocks of neighbouring documents. In each block, pairs
of ids that occur often are replaced by nonterminals, again and again; a block
stores its rules, the expanded length of every nonterminal and the remaining
symbols. The running sum of expanded lengths finds any document's tokens without
expanding the rest. Blocks are Parquet rows, so Spark's writer commits them: a lost
task leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of
from tallyframe.llm.units import unit_encoder

BLOCK_TOKENS = 1 << 19  # a block is closed once it holds so many
ROUNDS = 6  # of replacing; more rounds compress further and change nothing else
LEAST_COUNT = 24  # occurrences from which a pair gets a rule
RULES_A_ROUND = 8_192  # the most frequent pairs of a round; below 2^15, as slots hold their numbers
ENCODE_TOGETHER = 1 << 22  # bytes of texts in one call of the tokenizer, and what the last text has beyond
FILTER_BITS = 18


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules as rows of two symbols, first nonterminal).

    Each round counts all pairs of neighbours and makes rules for the most frequent;
    they are applied from left to right, a pair overlapping a replaced one waits for
    the next round. Rules used fewer than ``LEAST_COUNT`` times are given up.
    """
    symbols = ids.astype(np.int64)
    first = int(symbols.max(initial=0)) + 1
    made: list[np.ndarray] = []
    total = 0
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        narrow = first + total <= 1 << 16  # pairs of 16-bit symbols sort twice as fast
        keys = (symbols[:-1] << (16 if narrow else 32)) | symbols[1:]
        keys = keys.astype(np.uint32 if narrow else np.int64)
        ordered = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        counts = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        if len(often) > RULES_A_ROUND:
            often = np.sort(often[np.argsort(-counts[often], kind="stable")[:RULES_A_ROUND]])
        pairs = ordered[edge[often]]
        at, rule = _places(keys, pairs)
        used = np.bincount(rule, minlength=len(pairs))
        keep = used >= LEAST_COUNT
        if not keep.any():
            break
        number = np.cumsum(keep) - 1
        kept = keep[rule]
        at, rule = at[kept], number[rule[kept]]
        pairs = pairs[keep]
        symbols[at] = first + total + rule
        stays = np.ones(len(symbols), bool)
        stays[at + 1] = False
        symbols = symbols[stays]
        pairs = pairs.astype(np.int64)
        made.append(np.stack([pairs >> 16, pairs & 0xFFFF] if narrow else [pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        total += len(pairs)
    rules = np.concatenate(made) if made else np.empty((0, 2), np.int64)
    return symbols, rules, first


def _places(keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``pairs`` (ascending) among ``keys`` and which pair; of overlapping ones every second from the left."""
    if not len(pairs):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = keys.dtype.itemsize * 8
    kind = np.uint64 if wide == 64 else np.uint32
    spread, shift = kind(0x9E3779B97F4A7C15 >> (64 - wide)), kind(wide - FILTER_BITS)
    slots = (pairs.astype(kind) * spread) >> shift
    last = np.full(1 << FILTER_BITS, -1, np.int16)  # the last pair of a slot
    last[slots] = np.arange(len(pairs))
    of_keys = last.take((keys.astype(kind) * spread) >> shift)
    at = np.flatnonzero(of_keys >= 0)
    rule, wanted = of_keys.take(at).astype(np.int64), keys.take(at)
    hit = pairs.take(rule) == wanted
    if (last[slots] != np.arange(len(pairs))).any():  # slots of several pairs
        others = np.flatnonzero(~hit)
        rule[others] = np.minimum(np.searchsorted(pairs, wanted[others]), len(pairs) - 1)
        hit[others] = pairs[rule[others]] == wanted[others]
    at, rule = at[hit], rule[hit]
    if not len(at):
        return at, rule
    fresh_run = np.concatenate([[True], np.diff(at) > 1])
    start = np.flatnonzero(fresh_run)
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    chosen = nth % 2 == 0
    return at[chosen], rule[chosen]


def expanded_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Tokens that each nonterminal stands for; rules only use earlier ones."""
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[i] = (lengths[a - first] if a >= first else 1) + (lengths[b - first] if b >= first else 1)
    return lengths


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The tokens that the symbols stand for."""
    while (rest := symbols >= first).any():
        wide = np.repeat(symbols, 1 + rest)
        at = np.flatnonzero(rest) + np.arange(int(rest.sum()))
        pair = rules[symbols[rest] - first]
        wide[at], wide[at + 1] = pair[:, 0], pair[:, 1]
        symbols = wide
    return symbols


def tokens_between(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first: int, start: int, stop: int) -> np.ndarray:
    """Tokens start..stop-1 of a block, expanding only the symbols they lie in."""
    sizes = np.where(symbols >= first, lengths[np.maximum(symbols - first, 0)] if len(lengths) else 1, 1)
    ends = np.cumsum(sizes)
    low = int(np.searchsorted(ends, start, side="right"))
    high = int(np.searchsorted(ends, stop, side="left")) + 1
    before = int(ends[low - 1]) if low else 0
    return expand(symbols[low:high], rules, first)[start - before : stop - before]


def write_tokens(docs: DataFrame, id_col: str, text_col: str, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Write the token files of all rows to ``path``, in ascending id order.

    Rows go to ranges of (id, hash of the text), NULL ids first, so repeated ids
    with different texts can be split; each range is one shard of blocks. NULL texts
    are empty: the end id alone. Files hold one row per block: shard, block, start
    (tokens of the shard before it), tokens, ids and token counts of its documents,
    first nonterminal, rules, rule_lengths and symbols as little-endian 32-bit
    integers. An empty table writes no block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = unit_encoder(tokenizer, False), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        block = start = held = 0
        ids, lengths, parts = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal block, start, held
            symbols, rules, first = compress(np.frombuffer(b"".join(parts), "<u4"))
            binary = [x.astype("<u4").tobytes() for x in (rules, expanded_lengths(rules, first), symbols)]
            row = [shard, block, start, held, list(ids), list(lengths), first, *binary]
            made = pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            block, start, held = block + 1, start + held, 0
            for x in (ids, lengths, parts):
                x.clear()
            return made

        for whole in batches:
            kind = pa.list_(whole.schema.field(0).type)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), kind, pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
            before = np.concatenate([[0], np.cumsum(pc.binary_length(whole.column(1)).to_numpy(), dtype=np.int64)[:-1]])
            cuts = [*np.unique(before // ENCODE_TOGETHER, return_index=True)[1].tolist(), whole.num_rows] if whole.num_rows else []
            for at, stop in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(at, stop - at)
                for number, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                    ids.append(number)
                    lengths.append(len(found) // 4 + 1)
                    parts += [found, end]
                    held += lengths[-1]
                    if held >= BLOCK_TOKENS:
                        yield close()
        if ids:
            yield close()

    names = ["shard", "block", "start", "tokens", "ids", "lengths", "first", "rules", "rule_lengths", "symbols"]
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(
        blocks,
        f"shard int, block int, start bigint, tokens bigint, ids array<{kind}>, lengths array<bigint>, first bigint, "
        "rules binary, rule_lengths binary, symbols binary",
    ).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, tokens binary) per document: start counts the tokens of all documents before it."""
    files = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards = files.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    offsets = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("offset"))
    kind = files.schema["ids"].dataType.elementType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                offset, start, first = (batch.column(n)[row].as_py() for n in ("offset", "start", "first"))
                rules, symbols = (np.frombuffer(batch.column(n)[row].as_py(), "<u4").astype(np.int64) for n in ("rules", "symbols"))
                data = expand(symbols, rules.reshape(-1, 2), first).astype("<u4").tobytes()
                lengths = batch.column("lengths")[row].values.to_numpy()
                ends = np.cumsum(lengths)
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                starts = ends - lengths + (offset + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ids")[row].values, pa.array(starts), pa.array(lengths), pa.array(cut, pa.binary())],
                    names=["id", "start", "n_tokens", "tokens"],
                )

    placed = files.join(offsets, "shard").select("offset", "start", "first", "ids", "lengths", "rules", "symbols")
    return placed.mapInArrow(documents, f"id {kind}, start bigint, n_tokens bigint, tokens binary")
