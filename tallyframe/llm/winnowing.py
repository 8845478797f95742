"""Document fingerprints by winnowing.

All k-grams of characters are hashed; of every window of w neighbouring hashes the
smallest is kept, the rightmost of equal ones, with its position. Two texts that
share k + w - 1 characters in a row share a kept hash. Short texts use smaller
windows, which keep a superset, so the promise stands between texts of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import text_of

GRAM = 16  # characters hashed together; a power of two
WINDOW = 48  # hashes of which one is kept
LEAST_WINDOW, WINDOWS = 4, 8  # texts of few hashes still get about so many windows
# An odd base and the multiplier of a 64-bit mixing function.
BASE, MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def rolling_hashes(codes: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """32-bit hash of every run of ``gram`` codes; a shorter text is one run."""
    mask = (1 << 64) - 1
    h = codes.astype(np.uint64) + np.uint64(1)
    if len(h) < gram:
        value = 0
        for c in h.tolist():
            value = (value * BASE + c) & mask
        h = np.array([value] if len(codes) else [], np.uint64)
    else:
        span, power = 1, BASE
        while span < gram:  # a run of 2 s is a run of s, shifted, plus the next run of s
            h = h[:-span] * np.uint64(power) + h[span:]
            span, power = 2 * span, power * power & mask
    h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
    return (h >> np.uint64(32)).astype(np.uint64)


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of every window, rightmost among equals, ascending."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    flip = np.uint64((1 << 32) - 1)
    low = (hashes << np.uint64(32)) | (flip - np.arange(n, dtype=np.uint64))
    window = min(window, n)
    span = 1
    while 2 * span <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < window:
        low = np.minimum(low[: n - window + 1], low[window - span :])
    at = (flip - (low & flip)).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(kept hashes, their positions in code points), by position; none for the empty text."""
    hashes = rolling_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), gram)
    at = window_minima(hashes, max(LEAST_WINDOW, min(window, len(hashes) // WINDOWS)))
    return hashes[at].astype(np.uint32), at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of kept hashes, 0 to 1; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def written(hashes: np.ndarray) -> str:
    """Eight hex digits per kept hash, in the order of the text."""
    return hashes.astype(">u4").tobytes().hex()


def winnowed(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """Column array<struct<hash, position>> of the kept hashes; NULL and empty texts keep none."""

    @F.arrow_udf("array<struct<hash: bigint, position: bigint>>")
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            kept = [winnow(t.as_py() or "", gram, window) for t in batch]
            ends = np.cumsum([0, *[len(h) for h, _ in kept]]).astype(np.int32)
            hashes = np.concatenate([np.empty(0, np.int64), *[h.astype(np.int64) for h, _ in kept]])
            places = np.concatenate([np.empty(0, np.int64), *[p for _, p in kept]])
            marks = pa.StructArray.from_arrays([pa.array(hashes), pa.array(places)], ["hash", "position"])
            yield pa.ListArray.from_arrays(pa.array(ends), marks)

    return keep(text)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, borrowed, id, text): rows dealt in descending id order, each part ending with the row that follows it.

    Rows are ordered by id descending, NULL ids last, then by a hash of the text; the
    first row follows the last. Parts are ranges of ids between approximate
    quantiles, one per shuffle partition. Each text is shuffled once, and the first
    row of each part goes to the part before it as well, marked borrowed. The driver
    sees one bound and one first row's id per part.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    grid = ", ".join(f"{i / parts!r}D" for i in range(1, parts)) or "0.5D"
    found = rows.agg(F.expr(f"percentile_approx(id, array({grid}), {10 * max(parts, 1000)})").alias("at")).first()["at"]
    bounds = np.array(sorted(set(found or [])), np.int64)

    @F.arrow_udf("int")
    def range_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            below = np.searchsorted(bounds, batch.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="left")
            yield pa.array((len(bounds) - below).astype(np.int32))

    dealt = rows.withColumn("part", range_of(F.col("id").cast("bigint")))
    top = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie"))
    firsts = sorted((r["part"], r["top"]["id"], r["top"]["tie"]) for r in dealt.groupBy("part").agg(top.alias("top")).collect())
    order = [p for p, _, _ in firsts]
    before = {p: order[i - 1] for i, p in enumerate(order)}
    kind = docs.schema[id_col].dataType.simpleString()
    heads = spark.createDataFrame(
        [(p, i, t, before[p]) for p, i, t in firsts], f"head_part int, head_id {kind}, head_tie bigint, lender int"
    )
    first = (F.col("part") == F.col("head_part")) & F.col("id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    own = F.struct("part", F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("lender").alias("part"), F.lit(True).alias("borrowed"))
    goes = F.when(F.col("lender").isNotNull(), F.array(own, lent)).otherwise(F.array(own))
    placed = dealt.join(F.broadcast(heads), first, "left").select("id", "text", "tie", F.inline(goes))
    return (
        placed.repartition(parts, "part")
        .sortWithinPartitions("part", "borrowed", F.col("id").desc_nulls_last(), F.col("tie").desc())
        .select("part", "borrowed", "id", "text")
    )


def edit_likeness(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last third (rounded down) replaced by the first as many
    characters of the next row, see ``beside_next``. NULL texts are empty; an empty
    text is like an empty text (1) and unlike any other (0). Repeated rows follow one
    another. A table of one row is its own next; an empty table gives no rows.
    """
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = docs.schema[id_col].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # part, id, text and kept hashes of the row before
        for batch in batches:
            out = []
            for part, borrowed, number, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                kept = winnow(text)[0]
                if last is not None and last[0] == part:
                    out.append(_compared(*last[1:], text, kept))
                last = None if borrowed else (part, number, text, kept)
            if out:
                kinds = [batch.schema.field("id").type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    ordered = beside_next(docs, id_col, text_col)
    return ordered.mapInArrow(
        compare, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _compared(number, text: str, kept: np.ndarray, following: str, following_kept: np.ndarray) -> tuple:
    n = len(text)
    edited = text[: n - n // 3] + following[: n // 3]
    edited_kept = winnow(edited)[0]
    return (
        number,
        n,
        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
        written(kept),
        written(edited_kept),
        likeness(kept, edited_kept),
        likeness(kept, following_kept),
    )
