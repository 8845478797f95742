"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a node with the states bad and good. Node scores are
linear in features of the line and of the lines before and after it, edge scores
depend on the two states. Forward-backward gives each line's probability of being
good; a document's score is their mean weighted by line length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fold_of

TRAIN_DOCUMENTS = 2_000  # labelled documents fitted at most
TRAIN_LINES = 100  # lines of a chain in training; longer documents train as several chains
STEPS = 120
RATE = 0.3
DECAY = 1e-5
LETTERS = bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
UPPER, DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
SYMBOLS, MARKS, STOPS = b"#*$%&|<>~^=_\\{}[]@", b"!?", b".,;:"
FEATURES = 11  # of one line
LARGE = 1 << 16  # a line counts for so many characters at most when its length is a feature


def line_features(line: bytes, words: list[bytes]) -> list[float]:
    """Shares of character and word kinds in one line; every one lies in [0, 1]."""
    chars = sum(map(len, words))
    left = line.translate(None, LETTERS)
    upper = len(left) - len(left := left.translate(None, UPPER))
    digits = len(left) - len(left := left.translate(None, DIGITS))
    symbols = len(left) - len(left := left.translate(None, SYMBOLS))
    marks = len(left) - len(left := left.translate(None, MARKS))
    stops = len(left) - len(left.translate(None, STOPS))
    n = len(words)
    repeats = sum(map(eq, words, words[1:]))
    return [
        1.0,
        upper / chars,
        digits / chars,
        min(1.0, symbols / n),
        min(1.0, marks / n),
        min(1.0, stops / n),
        repeats / n,
        1.0 - len(set(words)) / n,
        min(1.0, chars / n / 20),
        float(line.rstrip()[-1:] in (b".", b"!", b"?")),
        math.log1p(min(chars, LARGE)) / math.log1p(LARGE),
    ]


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features of the line, its predecessor and successor), (length per line).

    Lines without a word are left out. A text without any counts as one line whose
    features are all zero.
    """
    rows, lengths = [], []
    for line in text.encode().split(b"\n"):
        words = line.split()
        if words:
            rows.append(line_features(line, words))
            lengths.append(len(line))
    own = np.array(rows) if rows else np.zeros((1, FEATURES))
    edge = np.zeros((1, FEATURES))
    around = np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])])
    return around, np.array(lengths or [1], float)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]  # of the state good against bad
    edges: tuple[float, float]  # staying bad, staying good, against a change


def marginals(nodes: np.ndarray, edges: tuple[float, float]) -> list[float]:
    """Probability of good per line; ``nodes`` are the scores of good against bad."""
    stay_bad, stay_good = math.exp(edges[0]), math.exp(edges[1])
    good = (1 / (1 + np.exp(-np.clip(nodes, -30, 30)))).tolist()
    n = len(good)
    ahead = [0.0] * n  # forward probability of good, normalised
    p = good[0]
    ahead[0] = p
    for t in range(1, n):
        g = good[t]
        one = (p * stay_good + (1 - p)) * g
        zero = ((1 - p) * stay_bad + p) * (1 - g)
        p = one / (one + zero)
        ahead[t] = p
    out = [0.0] * n
    back = 0.5  # backward message for good, normalised
    for t in range(n - 1, -1, -1):
        a = ahead[t] * back
        out[t] = a / (a + (1 - ahead[t]) * (1 - back))
        one = stay_good * good[t] * back + (1 - good[t]) * (1 - back)
        zero = good[t] * back + stay_bad * (1 - good[t]) * (1 - back)
        back = one / (one + zero)
    return out


def score(text: str, model: Model) -> float:
    features, lengths = document_features(text)
    good = marginals(features @ np.array(model.weights), model.edges)
    return float(np.clip(np.dot(lengths, good) / lengths.sum(), 0.0, 1.0))


def fit(documents: list[np.ndarray], labels: list[int]) -> Model:
    """Weights by gradient ascent on the conditional likelihood of the lines' labels (those of their documents)."""
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    sizes = np.array([len(documents[i]) for i in order])
    longest, n = int(sizes[0]), len(order)
    width = documents[0].shape[1]
    x = np.zeros((longest, n, width))
    for column, i in enumerate(order):
        x[: len(documents[i]), column] = documents[i]
    y = np.array([labels[i] for i in order], float)
    live = [int((sizes > t).sum()) for t in range(longest)]  # documents that have a line t
    w, edges = np.zeros(width), np.array([1.0, 1.0])
    theta = np.concatenate([w, edges])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    lines = sizes.sum()
    mask = np.arange(longest)[:, None] < sizes[None, :]
    seen = np.array([((sizes - 1) * (1 - y)).sum(), ((sizes - 1) * y).sum()])
    for step in range(1, STEPS + 1):
        nodes = np.clip(x @ theta[:width], -30, 30)
        good = 1 / (1 + np.exp(-nodes))
        stay = np.exp(theta[width:])
        ahead = np.zeros((longest, n))
        back = np.full((longest, n), 0.5)
        ahead[0] = good[0]
        for t in range(1, longest):
            m = live[t]
            p, g = ahead[t - 1, :m], good[t, :m]
            one, zero = (p * stay[1] + 1 - p) * g, ((1 - p) * stay[0] + p) * (1 - g)
            ahead[t, :m] = one / (one + zero)
        expected = np.zeros(2)
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            g, b, p = good[t + 1, :m], back[t + 1, :m], ahead[t, :m]
            both = np.stack([(1 - p) * stay[0] * (1 - g) * (1 - b), p * stay[1] * g * b, (1 - p) * g * b, p * (1 - g) * (1 - b)])
            expected += (both[:2] / both.sum(axis=0)).sum(axis=1)
            one, zero = stay[1] * g * b + (1 - g) * (1 - b), g * b + stay[0] * (1 - g) * (1 - b)
            back[t, :m] = one / (one + zero)
        marginal = ahead * back / (ahead * back + (1 - ahead) * (1 - back))
        miss = np.where(mask, y[None, :] - marginal, 0.0)
        slope = np.concatenate([np.tensordot(miss, x, 2), seen - expected]) / lines - DECAY * theta
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        theta[width:] = np.clip(theta[width:], -4.0, 4.0)
    return Model(tuple(theta[:width]), (float(theta[width]), float(theta[width + 1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str = "quality") -> Model:
    """A model from at most ``TRAIN_DOCUMENTS`` labelled documents with crc32(id) mod 5 other than 0.

    The sample is drawn by a hash of the id among the labels alone, so only its own
    texts are looked up. All their lines train: documents of more than ``TRAIN_LINES``
    lines as several chains, which only leaves out the links where they part. Several labels of one id count as their smallest; NULL ids, labels and
    texts do not train. Without both classes every text with a word scores the smoothed
    share of good labels.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).where(fold_of(id_col) != 0)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCUMENTS)  # a bounded sample
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.col("text").isNotNull())

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [document_features(t.as_py())[0] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([m.tobytes() for m in made], pa.binary())],
                names=["id", "label", "features"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    sample = texts.join(F.broadcast(chosen), "id").select("id", "label", "text")
    rows = sample.mapInArrow(numbers, f"id {kind}, label int, features binary").toPandas()
    rows = rows.sort_values(["id", "features"], kind="stable")
    if rows["label"].nunique() < 2:
        share = (float(rows["label"].sum()) + 1) / (len(rows) + 2)
        flat = [0.0] * (3 * FEATURES)
        return Model((math.log(share / (1 - share)), *flat[1:]), (0.0, 0.0))
    whole = [np.frombuffer(f).reshape(-1, 3 * FEATURES) for f in rows["features"]]
    chains = [(m[i : i + TRAIN_LINES], label) for m, label in zip(whole, rows["label"].tolist(), strict=True) for i in range(0, len(m), TRAIN_LINES)]
    return fit([c for c, _ in chains], [label for _, label in chains])


def quality(text: Column, model: Model) -> Column:
    """Double column in [0, 1]: the probability that the text is good; NULL counts as the empty text.

    A text without words is one line without features. Rows are independent and
    texts are processed whole, so ties, repeated rows and extra columns need no care.
    """

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([score(t.as_py() or "", model) for t in batch], pa.float64())

    return scored(text)
