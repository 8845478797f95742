"""Hashed maximum-entropy language model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(sub-class | class, context) +
log P(word | sub-class, context). Classes are a function of the word: the most frequent
words have one each, the others share classes by their last two bytes and sub-classes by
a hash of the whole word. The words of a sub-class are the leaves of a tree with a softmax
over at most ``SUBS`` branches at each node, so a word costs a few small softmaxes instead
of one over all words. All softmaxes are log-linear in hashed features of the context: a
bias, the word before, the two words before, and the word before the last (a skip); those
inside a class also depend on the class, those of the tree on the node. The biases of the
tree are the smoothed shares of the branches, which solve it without contexts.

Words are looked up once: a written table holds the texts as numbers of shared words,
and the words that are not shared beside them. Every task then follows the gradient
through its own rows from shared weights; Spark sums what the tasks have moved, each
feature weighted by its own tokens, and the next round starts from there.

What grows with the input: the counts of all words stay in a table, where rare words are
looked up by a join, and the hashed weights get a row for every ``ROW_TOKENS`` training
tokens. Two things go to every task: the words holding at least one in 2^20 of all
training tokens, hence at most 2^20 of them, with the trees over them, and the weights, at most
``MOST_FEATURES`` rows (256 MB); beyond that more contexts share a row. The rarer words
stand in one part of their tree that branches by a hash, at most ``REST_LEVELS`` times;
those that still share a leaf (more than 1.5 million rare words), and words never met,
divide it by their smoothed shares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b
from heapq import heapify, heappop, heappush
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import materialise, scratch_path

END = b"\n"  # no word holds white space
ALONE = 8  # most frequent words that are a class by themselves
CLASSES = 32
SUBS = 16  # sub-classes of a shared class, and branches of a node below
REST_LEVELS = 3  # branchings of the rare words of a sub-class at most
REST = SUBS**REST_LEVELS
RARE_LEAVES = 2  # leaves for each rare word, up to the bound
FEATURES = 1 << 14  # rows of the hashed weights at least
MOST_FEATURES = 1 << 20
ROW_TOKENS = 1 << 14  # training tokens that a row of the hashed weights stands for, below its bound
ACTIVE = 4  # features of a token
SHARED_WORDS = 1 << 20  # bound of the word table that every task gets
SHARED_BYTES = 64  # longer words are looked up in the join
SPREAD = np.uint64(0x9E3779B97F4A7C15)
ROUNDS = 2
RATE = 0.2
BATCH = 8_192  # tokens of a gradient step
LARGEST = np.float32(80.0)  # of a score
SHORT_RUN, LONG_RUN = 8, 48  # rows added one by one at first; rows from which a run is added alone
DOCUMENTS = 128  # texts whose tokens are looked up together
COUNTED = 500_000  # distinct words a task holds before it hands its counts on


def tokens(text: str) -> list[bytes]:
    """Words with A-Z folded, and the end."""
    words = text.encode().lower().split()
    words.append(END)
    return words


def word_counts(rows: DataFrame) -> DataFrame:
    """(token binary, n) over the column text; a NULL text is only an end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def handed() -> pa.RecordBatch:
            columns = [pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens(text.as_py() or ""))
                if len(seen) >= COUNTED:
                    yield handed()
        if seen:
            yield handed()

    partial = rows.select("text").mapInArrow(count, "token binary, n bigint")
    return partial.groupBy("token").agg(F.sum("n").alias("n"))


def shared_class(word: bytes) -> int:
    return ALONE + zlib.crc32(word[-2:]) % (CLASSES - ALONE)


def sub_class(word: bytes) -> int:
    return (zlib.crc32(word) >> 8) % SUBS


def rest_leaf(word: bytes) -> int:
    """Place among the rare words of a sub-class, as digits to the base ``SUBS``."""
    return (zlib.crc32(word) >> 12) % REST


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def feature_rows(tokens: int) -> int:
    """Rows of the hashed weights: a power of two that grows with the training tokens up to its bound."""
    rows = FEATURES
    while rows * ROW_TOKENS < tokens and rows < MOST_FEATURES:
        rows *= 2
    return rows


class WordTree:
    """Trees from the sub-classes down to their words.

    Shared words and the rest of a sub-class form an optimal code, so frequent words
    need one or two branchings; the rest branches on by hash digits.
    """

    def __init__(self, places: np.ndarray, counts: np.ndarray, rest: np.ndarray):
        """``places`` and ``counts`` of the shared words; ``rest``: smoothed mass of the leaves of the rare words, by place."""
        self.words, self.width = len(places), rest.shape[1]
        paths: list[list[int]] = [[] for _ in range(self.words + len(rest))]
        biases: list[list[float]] = []
        order = np.argsort(places, kind="stable")
        cuts = np.searchsorted(places[order], np.arange(len(rest) + 1))
        for place in range(ALONE * SUBS, len(rest)):
            own = order[cuts[place] : cuts[place + 1]]
            masses = [*(counts[own] + 0.5).tolist(), float(rest[place].sum(dtype=np.float64))]
            _code([*own.tolist(), self.words + place], masses, paths, biases)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int64)
        self.path = np.fromiter(chain.from_iterable(paths), np.int64, self.offsets[-1])
        levels, self.firsts, total = [np.array(biases, np.float32).reshape(-1, SUBS)], [], len(biases)
        below = 1
        while below < self.width:
            self.firsts.append(total)
            mass = rest.reshape(len(rest) * below, SUBS, -1).sum(axis=2)
            whole = mass.sum(axis=1, keepdims=True)
            levels.append(np.log(np.where(mass > 0, mass / np.where(whole > 0, whole, 1), 1)).astype(np.float32))
            total, below = total + len(mass), below * SUBS
        self.bias = np.concatenate(levels)
        self.log_rest = np.log(np.where(rest > 0, rest, 1)).astype(np.float32).ravel()

    def rest_leaves(self, places: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Leaf of rare words given by place and ``rest_leaf``."""
        return places * self.width + digits // (REST // self.width)

    def steps(self, numbers: np.ndarray, places: np.ndarray, missing: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, node, branch) of every branching on the way to the tokens; ``digits`` belong to the ``missing`` ones."""
        ends = np.where(numbers >= 0, numbers, self.words + places)
        starts = self.offsets[ends]
        lengths = self.offsets[ends + 1] - starts
        token = np.repeat(np.arange(len(numbers)), lengths)
        at = np.arange(len(token)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        found = [[token, self.path[at] // SUBS, self.path[at] % SUBS]]
        below = 1
        for first in self.firsts:
            prefix = digits // (REST // below)
            found.append([missing, first + places[missing] * below + prefix, digits // (REST // below // SUBS) % SUBS])
            below *= SUBS
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _code(items: list[int], masses: list[float], paths: list[list[int]], biases: list[list[float]]) -> None:
    """Optimal code with ``SUBS`` branches a node: the paths of ``items`` (node * SUBS + branch), and the log share of each branch."""
    heap = [(m, i) for i, m in enumerate(masses)]
    heapify(heap)
    first, made = len(biases), []
    take = (len(heap) - 2) % (SUBS - 1) + 2
    while len(heap) > 1:
        children = [heappop(heap) for _ in range(take)]
        whole = sum(m for m, _ in children)
        biases.append([float(np.log(m / whole)) for m, _ in children] + [-30.0] * (SUBS - take))  # -30: no word is there
        made.append([i for _, i in children])
        heappush(heap, (whole, len(items) + len(made) - 1))
        take = SUBS
    above: list[list[int]] = [[] for _ in made]
    for node in range(len(made) - 1, -1, -1):
        for branch, i in enumerate(made[node]):
            path = [*above[node], (first + node) * SUBS + branch]
            if i < len(items):
                paths[items[i]] = path
            else:
                above[i - len(items)] = path


@dataclass(frozen=True)
class Vocabulary:
    """The words every task knows, most frequent first, and the sizes of the sub-classes."""

    words: list[bytes]
    counts: np.ndarray
    mass: np.ndarray  # CLASSES x SUBS: smoothed tokens, with half a token for unknown words where words share
    tokens: int
    distinct: int
    tree: WordTree | None = None

    @property
    def log_mass(self) -> np.ndarray:
        return np.log(np.where(self.mass > 0, self.mass, 1.0))


class Lexicon:
    """Lookup arrays over a vocabulary, built once in each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.index = {w: i for i, w in enumerate(vocabulary.words)}
        self.places = np.array([self.place(w, i) for i, w in enumerate(vocabulary.words)], np.int64)
        self.hashes = np.array([word_hash(w) for w in vocabulary.words], np.uint64)
        self.weight = np.log10(vocabulary.counts + 0.5)
        self.rare: dict[bytes, bytes] = {}

    @staticmethod
    def place(word: bytes, index: int) -> int:
        """Class and sub-class of a word as one number."""
        return index * SUBS if 0 <= index < ALONE else shared_class(word) * SUBS + sub_class(word)

    def facts(self, word: bytes) -> bytes:
        """Hash, place and place among the rare words of a word that is not shared, as two 64-bit integers."""
        found = self.rare.get(word)
        if found is None:
            if len(self.rare) >= COUNTED:
                self.rare.clear()
            place = self.place(word, -1) * REST + rest_leaf(word)
            found = self.rare[word] = word_hash(word).to_bytes(8, "little") + place.to_bytes(8, "little")
        return found

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Number of every word, -1 for words that are not shared."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int32, len(words))


_last: list = [None, None]  # the vocabulary that this worker saw last, and its lexicon


def _lexicon(shared: Broadcast) -> Lexicon:
    if _last[0] is not shared.value:
        _last[:] = [shared.value, Lexicon(shared.value)]
    return _last[1]


def contexts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keys of the context features per token; contexts do not reach over the ends of documents."""
    n = len(hashes)
    first = np.zeros(n, bool)
    first[0:1] = True
    first[ends[:-1]] = True
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    one = np.concatenate([np.zeros(1, np.uint64), hashes[:-1] + np.uint64(1)])
    two = np.concatenate([np.zeros(min(2, n), np.uint64), hashes[:-2] + np.uint64(1)])
    one[first] = 0
    two[first | second] = 0
    return np.stack([one, (one * SPREAD) ^ two, two], axis=1) * np.uint64(4) + np.arange(1, ACTIVE, dtype=np.uint64)


def features(keys: np.ndarray, rows: int, inside: np.ndarray | None = None) -> np.ndarray:
    """Rows of the hashed weights; those of a softmax ``inside`` a class or node depend on it."""
    if inside is not None:
        keys = (keys * SPREAD) ^ ((inside.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))[:, None]
    return ((keys * SPREAD) >> np.uint64(64 - (rows - 1).bit_length())).astype(np.int64)


def _scores(bias: np.ndarray, weights: np.ndarray, group: np.ndarray | None, active: np.ndarray) -> np.ndarray:
    """Exponentiated scores of all branches; scores stay within what 32 bits hold after exponentiation."""
    scores = weights.take(active[:, 0], axis=0)
    for j in range(1, active.shape[1]):
        scores += weights.take(active[:, j], axis=0)
    scores += bias if group is None else bias.take(group, axis=0)
    np.clip(scores, -LARGEST, LARGEST, out=scores)
    return np.exp(scores, out=scores)


def log_probability(bias: np.ndarray, weights: np.ndarray, group: np.ndarray | None, active: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural log probability of the wanted branch per token, in sparse batches; without groups there is one bias."""
    out, ones = np.empty(len(wanted)), np.ones(weights.shape[1], np.float32)
    for i in range(0, len(wanted), BATCH):
        at = slice(i, i + BATCH)
        found = _scores(bias, weights, None if group is None else group[at], active[at])
        out[at] = np.log(found[np.arange(len(found)), wanted[at]] / (found @ ones))
    return out


def run_sums(rows: np.ndarray, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``rows[at]``, longest first, and their sums: all runs together row by row, then what long ones have left."""
    lengths = np.diff(np.append(starts, len(at)))
    order = np.argsort(-np.minimum(lengths, 32_767).astype(np.int16), kind="stable")
    starts, lengths = starts[order], lengths[order]
    out = rows.take(at[starts], axis=0)
    for k in range(1, SHORT_RUN):
        more = int(np.count_nonzero(lengths > k))
        if not more:
            return order, out
        out[:more] += rows.take(at[starts[:more] + k], axis=0)
    more, most = (int(np.count_nonzero(lengths > n)) for n in (SHORT_RUN, LONG_RUN))
    for run in range(most):
        rest = at[starts[run] + SHORT_RUN : starts[run] + lengths[run]]
        out[run] += np.ones(len(rest), rows.dtype) @ rows.take(rest, axis=0)
    if most < more:
        left = lengths[most:more] - SHORT_RUN
        first = np.cumsum(left) - left
        places = np.arange(int(left.sum())) + np.repeat(starts[most:more] + SHORT_RUN - first, left)
        out[most:more] += np.add.reduceat(rows.take(at[places], axis=0), first, axis=0)
    return order, out


class Softmax:
    """Weights of one softmax while a task moves them: hashed rows and, unless it is fixed, a bias per group."""

    def __init__(self, bias: np.ndarray, weights: np.ndarray, fixed_bias: bool = False):
        self.fixed_bias = fixed_bias
        self.bias, self.weights = bias if fixed_bias else bias.copy(), weights.copy()
        self.bias_squares, self.squares = None if fixed_bias else np.zeros_like(bias), np.zeros_like(weights)
        self.ones = np.ones(weights.shape[1], np.float32)

    def learn(self, group: np.ndarray, active: np.ndarray, wanted: np.ndarray) -> None:
        for i in range(0, len(wanted), BATCH):
            at = slice(i, i + BATCH)
            self.step(group[at], active[at], wanted[at])

    def step(self, group: np.ndarray, active: np.ndarray, wanted: np.ndarray) -> None:
        """One adaptive gradient step on a batch."""
        if not len(wanted):
            return
        size, width = active.shape
        slope = _scores(self.bias, self.weights, group, active)
        slope *= (np.float32(-1.0 / size) / (slope @ self.ones))[:, None]
        slope[np.arange(size), wanted] += np.float32(1.0 / size)
        # sorted with their places in one number, as rows and places are below 2^31
        ordered = np.sort((active.ravel() << 31) | np.arange(active.size))
        numbers, token = ordered >> 31, (ordered & ((1 << 31) - 1)) // width
        starts = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
        order, moved = run_sums(slope, token, starts)
        self._move(self.weights, self.squares, numbers[starts[order]], moved)
        if self.fixed_bias:
            return
        if len(self.bias) == 1:
            self._move(self.bias, self.bias_squares, np.zeros(1, np.int64), slope.sum(axis=0, keepdims=True))
            return
        by_group = np.argsort(group.astype(np.int16) if len(self.bias) < 1 << 15 else group, kind="stable")
        groups, starts = np.unique(group[by_group], return_index=True)
        self._move(self.bias, self.bias_squares, groups, np.add.reduceat(slope.take(by_group, axis=0), starts, axis=0))

    @staticmethod
    def _move(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, moved: np.ndarray) -> None:
        now = squares.take(rows, axis=0)
        now += moved * moved
        squares[rows] = now
        np.sqrt(now, out=now)
        now += np.float32(1e-6)
        np.divide(moved, now, out=now)
        now *= np.float32(RATE)
        now += weights.take(rows, axis=0)
        weights[rows] = now


@dataclass(frozen=True)
class Model:
    """The softmaxes: classes, sub-classes of a class, and branches down to the words of a sub-class."""

    class_bias: np.ndarray  # 1 x CLASSES
    class_weights: np.ndarray
    sub_bias: np.ndarray  # CLASSES x SUBS
    sub_weights: np.ndarray
    word_weights: np.ndarray | None = None  # of the branchings below the sub-classes; their biases are the vocabulary's

    @classmethod
    def start(cls, vocabulary: Vocabulary) -> Model:
        rows, log_mass = feature_rows(vocabulary.tokens), vocabulary.log_mass
        none = np.float32(-30.0)  # no word is there
        total = vocabulary.mass.sum(axis=1)
        class_bias = np.where(total > 0, np.log(np.maximum(total, 1e-300) / max(total.sum(), 1e-300)), none)
        sub_bias = np.where(vocabulary.mass > 0, log_mass - np.log(np.maximum(total, 1e-300))[:, None], none)
        empty = [np.zeros((rows, width), np.float32) for width in (CLASSES, SUBS, SUBS)]
        return cls(class_bias[None, :].astype(np.float32), empty[0], sub_bias.astype(np.float32), *empty[1:])

    def log_probabilities(self, hashes: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Natural log probability of every token's sub-class (class and sub-class given as one number)."""
        classes, subs = places // SUBS, places % SUBS
        keys, rows = contexts(hashes, ends), len(self.class_weights)
        out = log_probability(self.class_bias, self.class_weights, None, features(keys, rows), classes)
        inside = np.flatnonzero(classes >= ALONE)
        active = features(keys[inside], rows, classes[inside])
        out[inside] += log_probability(self.sub_bias, self.sub_weights, classes[inside], active, subs[inside])
        return out

    def word_log_probabilities(self, tree: WordTree, words: Words) -> np.ndarray:
        """Natural log probability of every token's leaf within its sub-class."""
        token, node, branch = tree.steps(words.numbers, words.places, words.missing, words.digits)
        active = features(contexts(words.hashes, words.ends)[token], len(self.word_weights), node)
        found = log_probability(tree.bias, self.word_weights, node, active, branch)
        return np.bincount(token, weights=found, minlength=len(words.numbers))


@dataclass(frozen=True)
class Words:
    """Tokens of some texts: numbers of the words, -1 for words that are not shared; these are ``missing`` and have digits."""

    numbers: np.ndarray
    hashes: np.ndarray
    places: np.ndarray
    ends: np.ndarray  # of the texts
    missing: np.ndarray
    digits: np.ndarray


def _decoded(lexicon: Lexicon, batch: pa.RecordBatch) -> Words:
    """The tokens of encoded rows."""
    numbers = np.frombuffer(b"".join(batch.column("words").to_pylist()), np.int32)
    rare = np.frombuffer(b"".join(batch.column("rare").to_pylist()), np.uint64).reshape(-1, 2)
    known = np.maximum(numbers, 0)
    hashes = lexicon.hashes[known] if len(lexicon.hashes) else np.zeros(len(numbers), np.uint64)
    places = lexicon.places[known] if len(lexicon.places) else np.zeros(len(numbers), np.int64)
    missing, facts = np.flatnonzero(numbers < 0), rare[:, 1].astype(np.int64)
    hashes[missing], places[missing] = rare[:, 0], facts // REST
    return Words(numbers, hashes, places, np.cumsum(batch.column("n_tokens").to_numpy()), missing, facts % REST)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, DOCUMENTS):
            yield batch.slice(at, DOCUMENTS)


def train(encoded: DataFrame, shared: Broadcast, vocabulary: Vocabulary) -> Model:
    """The model after ``ROUNDS`` rounds over the encoded training rows."""
    model = Model.start(vocabulary)
    if not vocabulary.tokens:
        return model
    rows = len(model.class_weights)
    for _ in range(ROUNDS):
        given = encoded.sparkSession.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            lexicon, old = _lexicon(shared), given.value
            upper, lower = Softmax(old.class_bias, old.class_weights), Softmax(old.sub_bias, old.sub_weights)
            lowest, tree = Softmax(shared.value.tree.bias, old.word_weights, fixed_bias=True), shared.value.tree
            met = [np.zeros(size, np.int64) for size in (1, rows, CLASSES, rows, rows)]
            for batch in _grouped(batches):
                words = _decoded(lexicon, batch)
                keys, classes = contexts(words.hashes, words.ends), words.places // SUBS
                inside = np.flatnonzero(classes >= ALONE)
                token, node, branch = tree.steps(words.numbers, words.places, words.missing, words.digits)
                own = classes[inside]
                active = [features(keys, rows), features(keys[inside], rows, own), features(keys[token], rows, node)]
                upper.learn(np.zeros(len(keys), np.int64), active[0], classes)
                lower.learn(own, active[1], words.places[inside] % SUBS)
                lowest.learn(node, active[2], branch)
                met[0] += len(keys)
                met[2] += np.bincount(own, minlength=CLASSES)
                for part, rows_met in zip((1, 3, 4), active, strict=True):
                    met[part] += np.bincount(rows_met.ravel(), minlength=rows)
            pairs = (
                (upper.bias, old.class_bias), (upper.weights, old.class_weights), (lower.bias, old.sub_bias), (lower.weights, old.sub_weights),
                (lowest.weights, old.word_weights),
            )
            for part, ((now, before), n) in enumerate(zip(pairs, met, strict=True)):
                touched = np.flatnonzero(n)
                moved = (now[touched] - before[touched]) * n[touched, None].astype(np.float32)
                if len(touched):
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(moved.ravel().astype(np.float64)), moved.shape[1])
                    columns = [pa.array(np.full(len(touched), part, np.int32)), pa.array(touched), pa.array(n[touched]), lists.cast(pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "feature", "n", "moved"])

        # a feature that one task has met keeps that task's whole move; one row per feature at most
        moves = encoded.select("n_tokens", "words", "rare").mapInArrow(learn, "part int, feature bigint, n bigint, moved array<double>")
        model = _moved(model, moves)
        given.unpersist()
    return model


def _moved(model: Model, moves: DataFrame) -> Model:
    """The model after the tasks' moves, averaged per feature."""
    parts = [x.copy() for x in (model.class_bias, model.class_weights, model.sub_bias, model.sub_weights, model.word_weights)]
    names = [f"d{c}" for c in range(CLASSES)]
    # one pass over the moves; narrower rows end in NULLs
    sums = [(F.sum(F.get("moved", F.lit(c))) / F.sum("n")).cast("float").alias(d) for c, d in enumerate(names)]
    total = moves.groupBy("part", "feature").agg(*sums).toPandas()
    for part, weights in enumerate(parts):
        own = total[total["part"] == part]
        weights[own["feature"].to_numpy()] += own[names[: weights.shape[1]]].to_numpy(np.float32)
    return Model(*parts)


def _encoded(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """Written once, by kind: 0 the rows with their words as numbers, 1 every place of a word that is not shared."""
    kind = rows.schema["id"].dataType.simpleString()
    names = ["kind", "row", "id", "training", "n_tokens", "words", "rare", "token"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, row = _lexicon(shared), TaskContext.get().partitionId() << 33
        for batch in _grouped(batches):
            split = [tokens(t or "") for t in batch.column("text").to_pylist()]
            lengths = np.array([len(s) for s in split])
            ends = np.cumsum(lengths)
            words = list(chain.from_iterable(split))
            numbers = lexicon.look_up(words)
            missing = np.flatnonzero(numbers < 0)
            cut = np.searchsorted(missing, np.concatenate([[0], ends])).tolist()
            rare = [words[i] for i in missing.tolist()]
            facts = list(map(lexicon.facts, rare))
            starts = (ends - lengths).tolist()
            n = batch.num_rows
            own = np.arange(row, row + n)
            row += n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(n, np.int32)), pa.array(own), batch.column("id"), batch.column("training"), pa.array(lengths),
                    pa.array([numbers[a:b].tobytes() for a, b in zip(starts, ends.tolist(), strict=True)], pa.binary()),
                    pa.array([b"".join(facts[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.binary()),
                    pa.nulls(n, pa.binary()),
                ],
                names=names,
            )
            n = len(rare)
            if n:
                empty = [pa.nulls(n, t) for t in (batch.column("id").type, pa.bool_(), pa.int64(), pa.binary(), pa.binary())]
                owners = pa.array(np.repeat(own, np.diff(cut)))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), owners, *empty, pa.array(rare, pa.binary())], names=names)

    fields = f"row bigint, id {kind}, training boolean, n_tokens bigint, words binary, rare binary, token binary"
    path = scratch_path(rows.sparkSession, "encoded")
    rows.mapInArrow(encode, f"kind int, {fields}").write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(f"{fields}, kind int").parquet(path)


def score_texts(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """One row per row of ``docs``: id, training, n_tokens, n_known, train_tokens, base_score, score.

    The rows where ``training`` holds train. Tokens are the words with A-Z folded
    and one end; NULL and empty texts are the end alone. base_score sums the log10 of
    smoothed unigram shares; score is the model's log10 probability; n_known counts
    tokens that occur in training. Repeated rows train and are scored each by itself;
    NULL ids are kept; an empty table gives no rows. Without training rows the base
    is even over no words. Rows are numbered in a written table, so a lost executor
    changes nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), training.alias("training")
    )
    counts = materialise(_placed(word_counts(rows.where("training"))))
    vocabulary = _vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)
    encoded = _encoded(rows, shared)
    texts = encoded.where("kind = 0")
    model = spark.sparkContext.broadcast(train(texts.where("training"), shared, vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["row", "id", "training", "n_tokens", "n_known", "weight", "model"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(shared)
        for batch in _grouped(batches):
            words = _decoded(lexicon, batch)
            numbers, ends, tree = words.numbers, words.ends, shared.value.tree
            found = model.value.log_probabilities(words.hashes, ends, words.places) + model.value.word_log_probabilities(tree, words)
            known = numbers >= 0
            # the counts of shared words are their leaf; those of the others come from the join
            found[words.missing] -= tree.log_rest[tree.rest_leaves(words.places[words.missing], words.digits)]
            found /= np.log(10)
            found[known] -= lexicon.weight[numbers[known]]
            weight = np.where(known, lexicon.weight[np.maximum(numbers, 0)], 0.0) if len(lexicon.weight) else np.zeros(len(numbers))
            starts = np.concatenate([[0], ends[:-1]])
            sums = [np.add.reduceat(known.astype(np.int64), starts), np.add.reduceat(weight, starts), np.add.reduceat(found, starts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), *map(pa.array, sums)], names=names)

    fields = f"row bigint, id {kind}, training boolean, n_tokens bigint, n_known bigint, weight double, model double"
    scored = texts.select("row", "id", "training", "n_tokens", "words", "rare").mapInArrow(score, fields)
    # words below the bound: each is rare, so no key of this join is hot
    rare = encoded.where("kind = 1").select("row", "token")
    met = rare.join(counts.select("token", "n"), "token", "left")
    more = met.groupBy("row").agg(
        F.count("n").alias("more_known"),
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more_weight"),
    )
    known = F.col("n_known") + F.coalesce("more_known", F.lit(0))
    # the half token of unknown words is divided evenly among the leaves of their sub-class
    spread = (F.col("n_tokens") - known) * F.lit(float(np.log10(vocabulary.tree.width)))
    weight = F.col("weight") + F.coalesce("more_weight", F.lit(0.0))
    even = float(np.log10(vocabulary.tokens + 0.5 * (vocabulary.distinct + 1)))
    return scored.join(more, "row", "left").select(
        "id",
        "training",
        "n_tokens",
        known.alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (weight - F.col("n_tokens") * F.lit(even)).alias("base_score"),
        (weight + F.col("model") - spread).alias("score"),
    )


def _placed(counts: DataFrame) -> DataFrame:
    """Counts with the class, sub-class and place among the rare words that each word shares."""
    by_suffix = F.lit(ALONE) + F.crc32(F.expr("substring(token, -2, 2)")) % (CLASSES - ALONE)
    by_word = F.shiftright(F.crc32("token"), 8) % SUBS
    rest = F.shiftright(F.crc32("token"), 12) % REST
    return counts.withColumns({"class": by_suffix.cast("int"), "sub": by_word.cast("int"), "rest": rest.cast("int")})


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """The shared words, at most ``SHARED_WORDS``, the sizes of all sub-classes, and the trees over their words."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
    least = max(1, -(-totals["tokens"] // SHARED_WORDS))
    is_shared = (F.col("n") >= least) & (F.octet_length("token") <= SHARED_BYTES)
    frequent = counts.where(is_shared).select("token", "n").toPandas()
    frequent = frequent.sort_values(["n", "token"], ascending=[False, True], kind="stable")
    mass = np.zeros((CLASSES, SUBS))
    mass[ALONE:] = 0.5
    for row in counts.groupBy("class", "sub").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        mass[row["class"], row["sub"]] += row["mass"]
    words = [bytes(w) for w in frequent["token"]]
    for i, (w, n) in enumerate(zip(words[:ALONE], frequent["n"][:ALONE], strict=True)):
        mass[shared_class(w), sub_class(w)] -= n + 0.5
        mass[i, 0] += n + 0.5
    rare, width = totals["distinct"] - len(words), 1
    while width < REST and (CLASSES - ALONE) * SUBS * width < RARE_LEAVES * rare:
        width *= SUBS
    rest = np.zeros((CLASSES * SUBS, width), np.float32)
    for row in _rest_masses(counts.where(~is_shared), width).collect():  # a row a sub-class
        rest[row["place"]] = np.frombuffer(row["masses"], np.float32)
    rest[ALONE * SUBS :] += np.float32(0.5 / width)
    numbers = frequent["n"].to_numpy(np.int64)
    places = np.array([Lexicon.place(w, i) for i, w in enumerate(words)], np.int64)
    return Vocabulary(words, numbers, mass, totals["tokens"], totals["distinct"], WordTree(places, numbers, rest))


def _rest_masses(rare: DataFrame, width: int) -> DataFrame:
    """(place, masses binary): smoothed tokens of the rare words of a sub-class, by the ``width`` leaves below it."""
    place = (F.col("class") * SUBS + F.col("sub")).alias("place")
    leaf = F.floor(F.col("rest") / (REST // width)).cast("int").alias("leaf")
    held = rare.groupBy(place, leaf).agg(F.sum(F.col("n") + 0.5).alias("mass"))

    def dense(leaves: pd.DataFrame) -> pd.DataFrame:
        masses = np.zeros(width, np.float32)
        masses[leaves["leaf"].to_numpy()] = leaves["mass"].to_numpy()
        return pd.DataFrame({"place": leaves["place"].iloc[:1], "masses": [masses.tobytes()]})

    return held.groupBy("place").applyInPandas(dense, "place int, masses binary")
