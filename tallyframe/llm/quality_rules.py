"""Weak supervision of document quality: rules vote or abstain, EM weighs them.

Everything runs as column expressions and one aggregation. Metrics come from one
pass over a text; each rule turns them into a vote; the number of documents per
vote pattern (at most 3 to the number of rules) is all that expectation
maximisation needs, so the driver sees a small table whatever the corpus size.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import fresh, materialise, text_of

SPACE = r"[\x20\x09-\x0D]"
MARKED = r"[#*$%&|<>][^\x20\x09-\x0D]*"  # one match per word with a symbol
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"  # a word without a letter
GOOD, BAD = 1, 0  # a NULL vote abstains
PRIOR_GOOD = 0.8  # share of good documents before any evidence
# Before any evidence a rule is right, wrong or abstains so often on a good and on a bad document.
PRIOR_RATES = ((0.80, 0.02, 0.18), (0.40, 0.30, 0.30))
PRIOR_WEIGHT = 20.0  # documents that these beliefs are worth
ROUNDS = 200
KEEP_FROM = 0.5


@dataclass(frozen=True)
class Rule:
    """A vote for or against a document, over the metric columns; neither condition met: abstain."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), BAD).when(F.expr(self.good), GOOD)


RULES = (
    Rule("word_size", "word_chars between 3 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 16 * n_words"),
    Rule("symbols", "20 * n_symbols < n_words", "10 * n_symbols > n_words"),
    Rule("marked_words", "20 * n_marked_words < n_words", "5 * n_marked_words > n_words"),
    Rule("lettered_words", "20 * n_bare_words < n_words", "5 * n_bare_words > n_words"),
    Rule("shouting", "100 * n_upper < 15 * word_chars", "100 * n_upper > 30 * word_chars"),
    Rule("exclaiming", "20 * n_exclaims < n_words", "10 * n_exclaims > n_words"),
    Rule("same_lines", "10 * n_dup_lines <= 2 * n_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("repeats", "10 * n_repeat_words < n_words", "10 * n_repeat_words > 4 * n_words"),
    Rule("stops", "n_stops * 40 >= n_words", "n_stops * 200 < n_words"),
)


def metrics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with a struct of counts over the whole text (NULL: no text) in the new column ``name``.

    Repeated three-word windows are found by sorting one long per window: hash bits
    above, position below. Equal neighbours repeat; the gaps between their sorted
    positions give the covered words. Linear memory and n log n time in the text.
    """
    text, words, lines, grams, keyed, places = (fresh(x) for x in ("text", "words", "lines", "grams", "keyed", "places"))
    bits = f"length(bin(size(`{words}`)))"
    steps = docs.withColumn(text, text_of(text_col))
    steps = steps.withColumns(
        {
            words: F.array_remove(F.split(text, SPACE + "+"), ""),
            lines: F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    steps = steps.withColumn(
        grams,
        F.expr(
            f"CASE WHEN size(`{words}`) < 3 THEN array() ELSE transform(sequence(0L, size(`{words}`) - 3L), i -> "
            f"shiftleft(xxhash64(get(`{words}`, i), get(`{words}`, i + 1), get(`{words}`, i + 2)), {bits}) | i) END"
        ).cast("array<bigint>"),
    )
    steps = steps.withColumn(keyed, F.sort_array(grams))
    same = f"shiftright(x, {bits}) = shiftright(get(`{keyed}`, j {{}} 1), {bits})"
    found = f"filter(`{keyed}`, (x, j) -> coalesce({same.format('-')}, false) OR coalesce({same.format('+')}, false))"
    steps = steps.withColumn(places, F.expr(f"sort_array(transform({found}, x -> x & (shiftleft(1L, {bits}) - 1L)))"))
    covered = (
        f"aggregate(transform(`{places}`, (p, j) -> least(3L, coalesce(get(`{places}`, j + 1) - p, 3L))), 0L, (s, x) -> s + x)"
    )
    counts = F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        (F.char_length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit("!")).cast("bigint").alias("n_exclaims"),
        F.regexp_count(text, F.lit(r"[.?](?![^\x20\x09-\x0D])")).cast("bigint").alias("n_stops"),
        F.regexp_count(text, F.lit(MARKED)).cast("bigint").alias("n_marked_words"),
        F.regexp_count(text, F.lit(BARE)).cast("bigint").alias("n_bare_words"),
    )
    return steps.withColumn(name, counts).drop(text, words, lines, grams, keyed, places)


def fit_rates(patterns: dict[tuple, int], rules: int) -> tuple[float, list]:
    """Share of good documents and, per rule, how often it is right, wrong or abstains on good and on bad ones.

    ``patterns`` counts documents by their votes; rules count as independent given
    the hidden quality. Expectation maximisation with Dirichlet priors, which keep
    the classes from swapping and the rates away from 0; without documents they are
    the result. A rule's accuracy on a class is right / (right + wrong).
    """
    share, rates = PRIOR_GOOD, [PRIOR_RATES] * rules
    for _ in range(ROUNDS):
        seen = [[[PRIOR_WEIGHT * x for x in PRIOR_RATES[y]] for y in (0, 1)] for _ in range(rules)]
        size = [PRIOR_WEIGHT * PRIOR_GOOD, PRIOR_WEIGHT * (1 - PRIOR_GOOD)]
        for votes, n in patterns.items():
            p = posterior(votes, share, rates)
            weight = (n * p, n * (1 - p))  # of the classes good and bad
            for y in (0, 1):
                size[y] += weight[y]
                for r, vote in enumerate(votes):
                    seen[r][y][_outcome(vote, y)] += weight[y]
        old, share = share, size[0] / sum(size)
        rates = [tuple(tuple(x / sum(row) for x in row) for row in rule) for rule in seen]
        if abs(old - share) < 1e-10:
            break
    return share, rates


def _outcome(vote: int | None, bad_class: int) -> int:
    """0 right, 1 wrong, 2 abstained."""
    return 2 if vote is None else int((vote == BAD) != bool(bad_class))


def log_odds(share: float, rates: list) -> tuple[float, list[dict]]:
    """Prior log odds of good, and per rule what each vote adds."""
    added = [{v: math.log(rule[0][_outcome(v, 0)] / rule[1][_outcome(v, 1)]) for v in (GOOD, BAD, None)} for rule in rates]
    return math.log(share / (1 - share)), added


def posterior(votes: tuple, share: float, rates: list) -> float:
    start, added = log_odds(share, rates)
    z = start + sum(rule[v] for v, rule in zip(votes, added, strict=True))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def judge(docs: DataFrame, text_col: str, name: str = "verdict", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with a struct column ``name``: the metrics, the votes, probability, base_failed, kept.

    A column of that name is replaced; all other columns and all rows stay, repeated
    ones too. NULL and empty texts have no words and fail the base check (under 50
    words, or over half of the words in repeated windows). kept is false for them and
    otherwise says whether the posterior probability of good reaches 0.5. The rows
    with their metrics are written once to the shared folder, so texts are read once.
    An empty table gives no rows.
    """
    held, votes = fresh("metrics"), fresh("votes")
    measured = metrics(docs.drop(name), text_col, held)
    measured = materialise(measured)
    numbers = measured.schema[held].dataType.names
    counts = measured.select(f"{held}.*").select(*[r.vote().alias(f"v{i}") for i, r in enumerate(rules)])
    voted = [f"v{i}" for i in range(len(rules))]
    patterns = {tuple(row[v] for v in voted): row["count"] for row in counts.groupBy(*voted).count().collect()}
    start, added = log_odds(*fit_rates(patterns, len(rules)))

    def over_metrics(expression: str) -> Column:
        """The rule text with metric names read from the struct."""
        for number in sorted(numbers, key=len, reverse=True):
            expression = _replace_word(expression, number, f"`{held}`.`{number}`")
        return F.expr(expression)

    ballot = F.array(*[F.when(over_metrics(r.bad), BAD).when(over_metrics(r.good), GOOD) for r in rules])
    judged = measured.withColumn(votes, ballot)
    z = F.lit(start)
    for i, rule in enumerate(added):
        vote = F.get(F.col(votes), F.lit(i))
        z = z + F.when(vote == GOOD, rule[GOOD]).when(vote == BAD, rule[BAD]).otherwise(rule[None])
    probability = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    failed = over_metrics("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    verdict = F.struct(
        *[F.col(f"`{held}`.`{n}`").alias(n) for n in numbers],
        F.col(votes).alias("votes"),
        probability.alias("probability"),
        failed.alias("base_failed"),
        (~failed & (probability >= KEEP_FROM)).alias("kept"),
    )
    return judged.withColumn(name, verdict).drop(held, votes)


def _replace_word(text: str, word: str, by: str) -> str:
    return re.sub(rf"(?<![\w`.]){word}(?![\w`])", by, text)
