"""Removal of long repeated byte strings through run-length indexes.

Every string of the wanted length is called a window. A window belongs to its anchor:
the gram with the smallest hash in it, the leftmost of equal ones. Equal windows have
equal anchors at equal places, so only grams that are anchors more than once matter. The
neighbouring windows of one anchor form a stretch; equal stretches collapse to one with
a count. Stretches are dealt to buckets by their anchor; each bucket builds a run-length
index and streams its matching statistics, which mark the windows that start elsewhere
too. Marks go back to all places of a stretch and on to the texts.

An anchor may stand in very many different stretches. Such a group is divided again and
again: all windows whose offset from the anchor lies in one half of a range share more
bytes than the anchor, and those bytes become the key. In the end a group holds a single
window, whose copies have collapsed. No group is cut off and none grows with the data.

Texts are written once, bucketed by a number that they get, so later passes join what
was found to the texts without moving the texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise, scratch_path, text_of
from tallyframe.llm.run_index import RunIndex

GRAM = 32  # bytes of an anchor, a multiple of eight
CHUNK = 1 << 16  # windows looked at together, few enough to stay in a core's cache
TOGETHER = 1 << 22  # bytes of texts joined for one look
BUCKET_BYTES = 1 << 18  # stretches of one index, whose arrays then stay in a core's cache
GROUP = 4_096  # different stretches of one key; more are divided
TEXT_BUCKET = 1 << 24  # bytes of texts in one bucket of the written copy
MAX_TEXT_BUCKETS = 1 << 16
LEVELS = 8  # offsets stay below 2^8, so ranges halve at most eight times
MIX = np.uint64(0x9E3779B97F4A7C15)
PLACE = 47  # bits of a position beside two offsets of eight bits; the sign stays free


def _hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the gram from each of the first n positions."""
    found, spare = np.zeros(n, np.uint64), np.empty(n, np.uint64)
    for j in range(0, GRAM, 8):
        found ^= np.ndarray((n,), "<u8", buffer=data[j:], strides=(1,))
        found *= MIX
        np.right_shift(found, np.uint64(29), out=spare)
        found ^= spare
    found *= MIX
    np.right_shift(found, np.uint64(32), out=spare)
    found ^= spare
    return found


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours, from running minima of blocks."""
    spare = -len(values) % width
    blocks = np.concatenate([values, np.full(spare, ~np.uint64(0))]).reshape(-1, width)
    after = np.minimum.accumulate(blocks, axis=1).ravel()
    before = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(before[:n], after[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, key, position of the anchor in the text, least and largest offset of its windows) of every stretch.

    ``data`` joins the texts, which lie between ``starts`` and ``ends``, and has spare
    bytes behind them. The offset of a window is the anchor's place in it.
    """
    size = int(ends[-1]) if len(ends) else 0
    width = length - GRAM + 1
    closed = np.zeros(size + 1, np.int8)  # windows would start here but reach over an end
    some = ends > starts
    np.add.at(closed, np.maximum(starts, ends - length + 1)[some], 1)
    np.add.at(closed, ends[some], -1)
    closed = np.cumsum(closed, dtype=np.int8)[:size]
    out = []
    for at in range(0, size, CHUNK):
        windows = np.flatnonzero(closed[at : at + CHUNK] == 0)
        if not len(windows):
            continue
        n = int(windows[-1]) + width
        hashes = _hashes(data[at:], n)
        place_bits = np.uint64((1 << 24) - 1)
        least = _sliding_least((hashes & ~place_bits) | np.arange(n, dtype=np.uint64), width)[windows]
        anchor = (least & place_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], len(anchor)) - 1
        chosen = anchor[first]
        out.append((chosen + at, hashes[chosen].view(np.int64), chosen - windows[last], chosen - windows[first]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    place, key, least, largest = (np.concatenate(c) for c in zip(*out, strict=True))
    text = np.searchsorted(ends, place, side="right")
    return text, key, place - starts[text], least, largest


def _pack(place: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
    return (least << (PLACE + 8)) | (largest << PLACE) | place


def _unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed & ((1 << PLACE) - 1), packed >> (PLACE + 8), (packed >> PLACE) & 255


def _joined(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, data, starts, ends) of a few MB of texts at a time."""
    sizes = np.array([len(t) for t in batch.column("text").to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
    at = 0
    while at < len(sizes):
        to = at + 1 + int(np.searchsorted(np.cumsum(sizes[at + 1 :]) + sizes[at], TOGETHER, side="right"))
        texts = batch.column("text").slice(at, to - at).to_pylist()
        ends = np.cumsum(sizes[at:to])
        yield at, np.frombuffer(b"".join(texts) + bytes(GRAM + 8), np.uint8), ends - sizes[at:to], ends
        at = to


def _stored(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(num, id, text binary) written once, bucketed by num."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(MAX_TEXT_BUCKETS, -(-total // TEXT_BUCKET)))
    numbered = rows.withColumn("num", F.monotonically_increasing_id()).repartition(buckets, "num")
    name = f"texts_{uuid.uuid4().hex[:12]}"
    path = scratch_path(spark, "texts")
    numbered.write.bucketBy(buckets, "num").option("path", path).option("compression", "zstd").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; the frame knows its buckets
    return stored


def _found(stored: DataFrame, length: int) -> DataFrame:
    """(key, num, place) of every stretch of every text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("num").to_numpy()
            for at, data, starts, ends in _joined(batch):
                text, key, place, least, largest = anchors(data, starts, ends, length)
                columns = [pa.array(key), pa.array(numbers[at + text]), pa.array(_pack(place, least, largest))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "num", "place"])

    return stored.select("num", "text").mapInArrow(find, "key bigint, num bigint, place bigint")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose key occurs more than once."""
    # written first: of known size, and a join with a hot key can then be split
    often = materialise(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return rows.join(often, "key", "left_semi")


def _with_texts(stored: DataFrame, rows: DataFrame, work, schema: str) -> DataFrame:
    """``work(text, table of the text's rows)`` for every text that has rows; it yields tuples of columns."""
    own = [c for c in rows.columns if c != "num"]
    listed = rows.groupBy("num").agg(F.collect_list(F.struct(*own)).alias("rows"))
    names = [f.split()[0] for f in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            bounds = lists.offsets.to_numpy()
            flat = lists.flatten()
            columns = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in own}
            base = bounds[0]
            made = []
            for number, text, low, high in zip(
                batch.column("num").to_pylist(), batch.column("text").to_pylist(), (bounds[:-1] - base).tolist(), (bounds[1:] - base).tolist(), strict=True
            ):
                made += work(number, text, {c: v[low:high] for c, v in columns.items()})
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], names=names)

    return stored.select("num", "text").join(listed, "num").select("num", "text", "rows").mapInArrow(each, schema)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _digested(stored: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """(key, digest, num, place): equal stretches of a key have equal digests."""

    def digest(number: int, text: bytes, rows: dict[str, np.ndarray]) -> list[tuple]:
        place, least, largest = _unpack(rows["place"])
        view, hashed = memoryview(text), xxhash.xxh3_64_intdigest
        lows, highs = (place - largest).tolist(), (place - least + length).tolist()
        digests = [_signed(hashed(view[a:b])) for a, b in zip(lows, highs, strict=True)]
        return list(zip(rows["key"].tolist(), digests, [number] * len(digests), rows["place"].tolist(), strict=True))

    return _with_texts(stored, shared, digest, "key bigint, digest bigint, num bigint, place bigint")


def _divided(stored: DataFrame, crowded: DataFrame, length: int, level: int) -> DataFrame:
    """The stretches again, in pieces by ranges of offsets of 2^(8 - level), keyed by the bytes that all windows of a range share."""
    width = 1 << (LEVELS - level)
    last = length - GRAM

    def divide(number: int, text: bytes, rows: dict[str, np.ndarray]) -> list[tuple]:
        view, hashed, out = memoryview(text), xxhash.xxh3_64_intdigest, []
        for place, least, largest in zip(*(c.tolist() for c in _unpack(rows["place"])), strict=True):
            for part in range(least // width, largest // width + 1):
                low, high = part * width, min(part * width + width - 1, last)
                common = view[place - low : place + length - high]
                a, b = max(low, least), min(high, largest)
                piece = view[place - b : place - a + length]
                packed = (a << (PLACE + 8)) | (b << PLACE) | place
                out.append((_signed(hashed(common, (level << 8) | part)), _signed(hashed(piece)), number, packed))
        return out

    return _with_texts(stored, crowded.select("num", "place"), divide, "key bigint, digest bigint, num bigint, place bigint")


def _marked(stored: DataFrame, groups: DataFrame, length: int) -> DataFrame:
    """(key, digest, first, last): windows of the stretches, counted from the stretch's start, that also start elsewhere."""
    place, least, largest = (F.col("row.place").bitwiseAND(F.lit((1 << PLACE) - 1)), F.shiftright("row.place", PLACE + 8), F.shiftright("row.place", PLACE).bitwiseAND(255))
    total = groups.agg(F.sum(largest - least + length)).first()[0] or 0
    buckets = -(-total // BUCKET_BYTES) or 1

    def extract(number: int, text: bytes, rows: dict[str, np.ndarray]) -> list[tuple]:
        place, least, largest = _unpack(rows["place"])
        cut = [text[a:b] for a, b in zip((place - largest).tolist(), (place - least + length).tolist(), strict=True)]
        return list(zip(*(rows[c].tolist() for c in ("bucket", "key", "digest", "many")), cut, strict=True))

    chosen = groups.select(
        "row.num", "row.place", "key", "digest", (F.col("n") > 1).alias("many"), F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")
    )
    texts = _with_texts(stored, chosen, extract, "bucket bigint, key bigint, digest bigint, many boolean, stretch binary")

    def index(table: pa.Table) -> pa.Table:
        stretches = table["stretch"].to_pylist()
        built = RunIndex(stretches)
        repeated = built.matching_statistics() >= length
        sizes = np.fromiter(map(len, stretches), np.int64, len(stretches))
        for i in np.flatnonzero(table["many"].to_numpy()).tolist():
            repeated[built.starts[i] : built.starts[i] + sizes[i] - length + 1] = True
        edge = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2] - 1  # the bytes before an end start no window, so no run leaves its text
        text = np.searchsorted(built.starts, first, side="right") - 1
        return pa.table(
            {
                "key": table["key"].take(pa.array(text)), "digest": table["digest"].take(pa.array(text)),
                "first": pa.array((first - built.starts[text]).astype(np.int32)), "last": pa.array((last - built.starts[text]).astype(np.int32)),
            }
        )

    return texts.groupBy("bucket").applyInArrow(index, "key bigint, digest bigint, first int, last int")


def _united(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the intervals, which may overlap or touch."""
    by_start = np.argsort(starts, kind="stable")
    starts, ends = starts[by_start], np.maximum.accumulate(ends[by_start])
    fresh = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.append(np.flatnonzero(fresh)[1:], len(starts)) - 1
    return list(zip(starts[fresh].tolist(), ends[last].tolist(), strict=True))


def drop_long_matches(docs: DataFrame, id_col: str, text_col: str, length: int = 200) -> DataFrame:
    """(id, n_bytes, spans, kept): every text without the bytes that lie in a repeated string of ``length`` bytes.

    A string counts as repeated if it also starts at any other place, in another row or
    in the same, overlapping itself or not; strings are judged on the whole input and
    never reach over the end of a text. spans lists the maximal removed runs as structs of
    start and end in bytes of the text; kept is binary, as a run may end within a
    character. NULL texts are empty. Repeated rows are texts of their own, so long equal
    texts all go. NULL and repeated ids are kept as they are, texts shorter than
    ``length`` are left alone, an empty table gives no rows, and other columns are left
    out. Texts must be UTF-8, as Spark's strings are.
    """
    if not GRAM < length < GRAM + (1 << LEVELS):
        raise ValueError(f"length must be between {GRAM + 1} and {GRAM + (1 << LEVELS) - 1}")
    stored = _stored(docs, id_col, text_col)
    shared = materialise(_repeated(_found(stored, length)))
    places = materialise(_digested(stored, shared, length))
    whole = []
    for level in range(1, LEVELS + 2):
        groups = materialise(places.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("num", "place")).alias("row")))
        if level > LEVELS:  # keys of single windows have one digest each
            whole.append((places, groups))
            break
        crowded = materialise(groups.groupBy("key").agg(F.count("*").alias("different")).where(F.col("different") > GROUP).select("key"))
        whole.append((places.join(crowded, "key", "left_anti"), groups.join(crowded, "key", "left_anti")))
        if crowded.isEmpty():
            break
        places = materialise(_repeated(_divided(stored, places.join(crowded, "key", "left_semi"), length, level)))
    places, groups = whole[0]
    for more_places, more_groups in whole[1:]:
        places, groups = places.unionByName(more_places), groups.unionByName(more_groups)
    marks = materialise(_marked(stored, groups, length))
    hits = places.join(marks, ["key", "digest"]).select("num", "place", "first", "last")
    listed = hits.groupBy("num").agg(F.collect_list(F.struct("place", "first", "last")).alias("rows"))
    id_kind = stored.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans, sizes = [], [], []
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("rows"), strict=True):
                sizes.append(len(text))
                if not rows.is_valid:
                    kept.append(text)
                    spans.append([])
                    continue
                place, first, last = (rows.values.field(c).to_numpy() for c in ("place", "first", "last"))
                at, _, largest = _unpack(place)
                gone = _united(at - largest + first, at - largest + last + length)
                spans.append([{"start": a, "end": b} for a, b in gone])
                edges = [0, *[x for run in gone for x in run], len(text)]
                kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "spans", "kept"])

    joined = stored.join(listed, "num", "left").select("id", "text", "rows")
    return joined.mapInArrow(cut, f"id {id_kind}, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
