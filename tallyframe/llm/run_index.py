"""A run-compressed Burrows-Wheeler transform over a collection of byte strings.

The transform is kept as runs. At both ends of every run the text position is sampled,
with the length of the match to the neighbour in suffix order across that border. These
samples give the longest match of every position with any other place: between two
samples the neighbours move along with the position, so the match just gets one byte
shorter with every step. Repetitive texts have few runs, hence few samples.
"""

from __future__ import annotations

import numpy as np

END = 0xFF  # ends a text; no UTF-8 text holds it
FIRST = 8  # bytes of the first sort


def _words(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every position; ``data`` has eight spare bytes at its end."""
    return np.ndarray((len(data) - 8,), f"{order}u8", buffer=data, strides=(1,))


def suffix_order(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Positions in suffix order; ``left`` counts the bytes to the end of each position's text.

    Ends of texts differ from each other and follow the order of the texts. Prefix
    doubling: only positions that are still tied are sorted again.
    """
    n = len(left)
    words = _words(data, ">").astype(np.uint64)
    short = left < FIRST
    words[short] &= ~np.uint64(0) << (np.uint64(8) * (FIRST - 1 - left[short]).astype(np.uint64))
    order = np.argsort(words)
    words = words[order]
    fresh = np.ones(n, bool)
    np.not_equal(words[1:], words[:-1], out=fresh[1:])
    # equal up to their ends: by position, which settles every later tie at an end too
    ended = np.flatnonzero(short[order])
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    order[ended] = order[ended][np.lexsort((order[ended], start[ended]))]
    fresh[ended] = True
    start[ended] = ended
    rank = np.empty(n, np.int64)
    rank[order] = start
    tied = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
    group, reach = start[tied], FIRST
    while len(tied):
        at = order[tied]
        key = group * n
        key += rank[at + reach]
        by_key = np.argsort(key)
        at, key = at[by_key], key[by_key]
        order[tied] = at
        fresh = np.ones(len(tied), bool)
        np.not_equal(key[1:], key[:-1], out=fresh[1:])
        group = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[at] = group
        still = ~(fresh & np.append(fresh[1:], True))
        tied, group = tied[still], group[still]
        reach *= 2
    return order


class RunIndex:
    """Runs and samples of a list of byte strings without the byte 0xFF.

    ``starts`` are the places of the texts in the joined data, ``run_bytes`` and
    ``run_lengths`` the transform, ``heads`` and ``tails`` the sampled positions at the
    ends of the runs, with ``head_matches`` and ``tail_matches`` bytes shared with the
    neighbour beyond the border.
    """

    def __init__(self, texts: list[bytes]):
        end = bytes([END])
        joined = end.join(texts) + (end if texts else b"")
        data = np.frombuffer(joined + bytes(16), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ends = np.cumsum(lengths)
        self.starts, self.size = ends - lengths, len(joined)
        left = np.repeat(ends - 1, lengths) - np.arange(self.size)
        if not texts:
            self.run_bytes, self.run_lengths = np.zeros(0, np.uint8), np.zeros(0, np.int64)
            self.heads = self.tails = self.head_matches = self.tail_matches = np.zeros(0, np.int64)
            return
        order = suffix_order(data[: self.size + 8], left)
        before = data[np.where(order > 0, order - 1, self.size - 1)]
        border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == END)) + 1
        first = np.concatenate([[0], border])
        self.run_bytes, self.run_lengths = before[first], np.diff(np.append(first, self.size))
        shared = self._shared(data, left, order[border - 1], order[border])
        self.heads, self.head_matches = order[first], np.concatenate([[0], shared])
        self.tails, self.tail_matches = order[np.append(border - 1, self.size - 1)], np.append(shared, 0)

    @staticmethod
    def _shared(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the texts from a and from b share, up to the ends of the texts."""
        words = _words(data, "<")
        most = np.minimum(left[a], left[b])
        found = np.zeros(len(a), np.int64)
        going = np.flatnonzero(most > 0)
        while len(going):
            differ = words[a[going] + found[going]] ^ words[b[going] + found[going]]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            found[going] += same
            going = going[(same == 8) & (found[going] < most[going])]
        return np.minimum(found, most)

    def matching_statistics(self) -> np.ndarray:
        """For every position of the joined data the longest match, within its text, that also starts at another position."""
        best = np.zeros(self.size, np.int64)
        for places, matches in ((self.heads, self.head_matches), (self.tails, self.tail_matches)):
            by_place = np.argsort(places)
            places, matches = places[by_place], matches[by_place]
            span = np.diff(np.append(places, self.size))
            best = np.maximum(best, np.repeat(places + matches, span) - np.arange(self.size))
        return best
