"""Byte-level BPE as a tree reduction over a monoid.

A piece of text is halved until it is short, the short parts are merged by rank,
and neighbours are joined on the way up. A join re-encodes a window of tokens
around the seam. It may stop once the pairs of tokens at both rims of the window
are *stable*, i.e. the two tokens' joint bytes encode to just these two tokens:
a token sequence whose adjacent pairs are all stable is the encoding of its bytes,
because the first merge across any seam would also happen when only the two
tokens beside that seam are encoded. Until then the window grows on the side that
failed. The join is associative with the empty sequence as its unit.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.llm.units import CACHE_UNITS, unsafe_spaces

LEAF_BYTES = 16  # parts this short are merged directly
LEAF_IDS = 1024  # ids decoded in one leaf of the decoding tree


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class ByteBPE:
    """Encoder and decoder for one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.units: dict[str, bytes] = {}
        self.stable = lru_cache(maxsize=200_000)(self._stable)
        self.piece = lru_cache(maxsize=100_000)(self._piece)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of a short byte string: merge the lowest-ranked pair, leftmost first, until none is left."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        joined = [ranks.get(data[i : i + 2]) for i in range(len(data) - 1)]
        while True:
            known = [rank for rank in joined if rank is not None]
            if not known:
                return [ranks[part] for part in parts]
            at = joined.index(min(known))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del joined[at]
            if at < len(joined):
                joined[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                joined[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _stable(self, left: int, right: int) -> bool:
        return self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbouring byte strings from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a, b = 1, 1
        while True:
            window = left[-a:] + right[:b]
            middle = self.merge(b"".join([self.bytes_of[i] for i in window]))
            left_done = a >= len(left) or self.stable(left[-a - 1], middle[0])
            right_done = b >= len(right) or self.stable(middle[-1], right[b])
            if left_done and right_done:
                return left[: len(left) - a] + middle + right[b:]
            a = a if left_done else min(len(left), 2 * a)
            b = b if right_done else min(len(right), 2 * b)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        return np.array([whole] if whole is not None else self.tree(data), "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        return b"".join([self.piece(p) for p in self.split(unit)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        Every match of the pattern is encoded by itself. Cutting before a single
        blank never cuts a match, so recurring words come from a bounded cache.
        """
        if unsafe_spaces(text):
            return self._unit(text)
        units, out = self.units, []
        first, *rest = text.split(" ")
        out.append(self._unit(first))
        for unit in rest:
            ids = units.get(unit)
            if ids is None:
                if len(units) >= CACHE_UNITS:
                    units.clear()
                ids = self._unit(" " + unit)
                if len(unit) <= 64:
                    units[unit] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids: leaves are decoded, then neighbours concatenated level by level."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        get = self.bytes_of.__getitem__
        level = [b"".join(map(get, numbers[i : i + LEAF_IDS])) for i in range(0, len(numbers), LEAF_IDS)]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def _coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(read_ranks(path), pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """Binary column of the ids of ``text`` (NULL: the empty text, no ids), little-endian unsigned 32-bit.

    Rows are independent and the text is processed whole: a column expression, so
    repeated rows, extra columns and empty tables need no care. The rank file is
    read once in each Python worker from ``path``, which must exist on every node.
    """

    @F.arrow_udf("binary")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            yield pa.array([coder.encode(t.as_py() or "") for t in batch], pa.binary())

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """Binary column of the bytes that the ids stand for; NULL counts as no ids. Unknown ids raise."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(path, pattern)
        for batch in batches:
            yield pa.array([coder.decode(b.as_py() or b"") for b in batch], pa.binary())

    return decode(ids)


Encoder = Callable[[str], bytes]
