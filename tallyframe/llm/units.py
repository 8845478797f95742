"""Words of a text as units that a byte-level or word tokenizer can encode one by one."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_UNITS = 400_000  # words in one generation of a worker's cache
CACHED_CHARS = 64  # longer words are not kept

_unsafe = re.compile(r"\s \s|\s \Z").search
# letters that stay single letters when they are composed and folded, then signs: no pattern joins a letter with a sign behind it
_simple = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u0523]+)([!-/:-@\[-`{-~]*)").fullmatch
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def unsafe_spaces(text: str) -> bool:
    """Whether cutting before every blank could cut a run of white space differently from a pattern over the whole text."""
    return "  " in text or _unsafe(text) is not None


class UnitEncoder:
    """Ids of whole texts by the tokenizers library, with recurring words encoded once.

    ``keep_blank``: a word carries the blank before it (byte-level vocabularies);
    otherwise white space only separates words. New words of a batch go through the
    library in one call, separated by ``separator``, whose ids mark the seams. Where
    the vocabulary marks the ends of words, plain words go without separators and
    their case is folded as the library folds it, so each form is encoded once.
    """

    def __init__(self, path: str, keep_blank: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens stand for themselves, as the library reads them by default; a text that may hold one is not cut
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.signs = {t[:2] for t in self.added}  # a quick test, which lower case does not change
        if any(len(t) < 3 or any(c.isalpha() for c in t[:2]) for t in self.added):
            raise ValueError("added tokens must begin with two signs")
        self.keep_blank = keep_blank
        self.separator = "\n" if keep_blank else " \x00 "
        marks = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        if len(marks) != 1:
            raise ValueError("the separator must be a single token")
        self.mark = marks[0]
        self.word_ends = self._word_ends()
        if self.word_ends is not None:
            self.folded = Tokenizer.from_file(path)
            self.folded.normalizer = None  # it would leave folded plain letters as they are
        self.known: dict[str, bytes] = {}  # the young generation
        self.old: dict[str, bytes] = {}  # words of the generation before, until they are met again
        self.firsts: dict[str, bytes] = {}  # words at the start of a text, which have no blank before them

    def _word_ends(self) -> np.ndarray | None:
        """Whether an id ends a word, by id; None where words are not folded, cut at signs and ended by a suffix."""
        tokenizer, suffix = self.tokenizer, getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if self.keep_blank or not suffix or tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
            return None
        normalizer = json.loads(tokenizer.to_str())["normalizer"]
        steps = normalizer.get("normalizers", [normalizer])
        blanks = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
        cut = tokenizer.pre_tokenizer.pre_tokenize_str
        if {"type": "Lowercase"} not in steps or any(step not in ({"type": "NFC"}, {"type": "Lowercase"}, blanks) for step in steps):
            return None
        if any(len(cut("a" + sign)) != 2 for sign in SIGNS):
            return None
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return ends

    def _ids(self, text: str, tokenizer=None) -> np.ndarray:
        # the fast call leaves out character offsets
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _may_hold_added(self, text: str) -> bool:
        if not any(signs in text for signs in self.signs):
            return False
        lowered = text.lower()  # some vocabularies look for added tokens after folding case
        return any(token in lowered for token in self.added)

    def _direct(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        if self.word_ends is not None:
            words = self._learn_simple(words, into)
        blank = " " if self.keep_blank else ""
        plain = [w for w in words if w and w.isprintable()]  # no white space but the blank, no control characters
        for word in set(words).difference(plain):
            into[word] = self._direct(blank + word)
        if not plain:
            return
        text = self.separator.join([blank + w for w in plain])
        ids = self._ids(text)
        seams = np.flatnonzero(ids == self.mark)
        if len(seams) != len(plain) - 1:
            raise ValueError("separators and words do not match")
        starts = np.concatenate([[0], seams + 1]) * 4
        ends = np.concatenate([seams, [len(ids)]]) * 4
        data = ids.tobytes()
        into.update(zip(plain, [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], strict=True))

    def _learn_simple(self, words: list[str], into: dict[str, bytes]) -> list[str]:
        """Learn the words of plain letters with signs behind them, the letters once for all of these; the other words."""
        plain, signed, rest = set(), [], []
        for word in words:
            match = _simple(word)
            if match is None:
                rest.append(word)
                continue
            letters, tail = match.groups()
            folded = letters.lower()
            if folded not in into:
                plain.add(folded)
            if tail or folded != letters:
                signed.append((word, folded, tail))
        if plain:
            ids = self._ids(" ".join(plain), self.folded)
            ends = ((np.flatnonzero(self.word_ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(plain):
                return words
            data = ids.tobytes()
            into.update(zip(plain, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        for word, letters, tail in signed:
            into[word] = into[letters] + self._first(tail)
        return rest

    def _cut(self, text: str) -> tuple[str, str | None]:
        """The word at the start that has no blank before it, and the text whose blanks separate the others, if any."""
        if self.keep_blank:
            start, blank, rest = text.partition(" ")
            return start, rest if blank else None
        if self.word_ends is not None:
            try:
                text.encode("latin-1")  # of these every letter is folded by itself, before composing as well as after
                text = text.lower()
            except UnicodeEncodeError:
                pass
        return "", text.replace("\n", " ").replace("\t", " ").replace("\r", " ")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        whole = [(self.keep_blank and unsafe_spaces(t)) or self._may_hold_added(t) for t in texts]
        starts, rests = zip(*[("", None) if w else self._cut(t) for t, w in zip(texts, whole, strict=True)], strict=True)
        units = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = units.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        number = coded.indices.to_numpy()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_UNITS:
            self.old, self.known = self.known, {}
            new = set(words)
        again = {w: self.old[w] for w in new if w in self.old}
        self.known.update(again)
        new.difference_update(again)
        if new:
            self._learn(list(new), self.known)
        found = list(map(self.known.__getitem__, words))
        # the ids of all words one after another, copied from those of the different words
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        firsts, lengths = np.cumsum(sizes) - sizes, sizes[number]
        ends = np.cumsum(lengths)
        places = np.arange(int(lengths.sum())) + np.repeat(firsts[number] - (ends - lengths), lengths)
        data = np.frombuffer(b"".join(found), "<u4")[places].tobytes()
        last = np.cumsum(pc.fill_null(pc.list_value_length(units), 0).to_numpy())  # words up to the end of each text
        stops = (np.concatenate([[0], ends])[last] * 4).tolist()
        out = []
        for text, cut, start, a, b in zip(texts, whole, starts, [0, *stops], stops, strict=False):
            out.append(self._direct(text) if cut else self._first(start) + data[a:b])
        for word in [w for w in new if len(w) > CACHED_CHARS]:
            self.known.pop(word, None)
        return out

    def _first(self, word: str) -> bytes:
        if word == "":
            return b""
        ids = self.firsts.get(word)
        if ids is None:
            ids = self._direct(word)
            if len(word) <= CACHED_CHARS:
                if len(self.firsts) >= CACHE_UNITS // 8:
                    self.firsts.clear()
                self.firsts[word] = ids
        return ids


@lru_cache(maxsize=4)
def unit_encoder(path: str, keep_blank: bool) -> UnitEncoder:
    return UnitEncoder(path, keep_blank)
