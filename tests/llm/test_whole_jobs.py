"""Tests of the places where an operator once did less than the whole job."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import maxent


def test_lm_contexts_act_inside_a_class(frame):
    common = " ".join(f"c{i}" * 2 for i in range(10))
    rows = [(i, f"{common} {common} " + ("alpha first_on" if i % 2 else "beta second_on")) for i in range(20)]
    asked = [(100, "alpha first_on"), (101, "alpha second_on")]  # equal counts and one class
    assert maxent.shared_class(b"first_on") == maxent.shared_class(b"second_on")
    got = {r.id: r.score for r in maxent.score_texts(frame(rows + asked), "doc_id", "text", F.col("doc_id") < 100).collect()}
    assert got[100] > got[101] + 0.5


def test_lm_contexts_act_inside_a_sub_class(frame, monkeypatch):
    same: dict = {}
    for i in range(10_000):
        word = f"x{i}_on"
        group = same.setdefault(maxent.Lexicon.place(word.encode(), -1), [])
        group.append(word)
        if len(group) == 2:
            break
    first, second = group
    assert len({maxent.rest_leaf(w.encode()) for w in group}) == 2
    common = " ".join(f"c{i}" * 2 for i in range(10))
    rows = [(i, f"{common} {common} " + (f"alpha {first}" if i % 2 else f"beta {second}")) for i in range(20)]
    asked = [(100, f"alpha {first}"), (101, f"alpha {second}")]  # equal counts, one class and one sub-class

    def scores():
        return {r.id: r.score for r in maxent.score_texts(frame(rows + asked), "doc_id", "text", F.col("doc_id") < 100).collect()}

    got = scores()
    assert got[100] > got[101] + 0.2
    monkeypatch.setattr(maxent, "SHARED_WORDS", 20)  # both words are rare now
    got = scores()
    assert got[100] > got[101] + 0.2


def test_lm_words_of_a_sub_class_sum_to_one():
    place, other = maxent.ALONE * maxent.SUBS, maxent.ALONE * maxent.SUBS + 1
    rng = np.random.default_rng(4)
    for shared in (0, 1, 5, 40, 300):
        counts = np.sort(rng.integers(1, 1000, shared + 3))[::-1]
        places = np.full(shared + 3, place)
        places[shared:] = other  # of another sub-class
        for levels in range(maxent.REST_LEVELS + 1):
            rest = np.zeros((maxent.CLASSES * maxent.SUBS, maxent.SUBS**levels))
            rest[place:] = 0.5
            rest[place] += rng.random(rest.shape[1])
            tree = maxent.WordTree(places, counts, rest)
            numbers = np.append(np.arange(shared), np.full(rest.shape[1], -1))
            missing = np.flatnonzero(numbers < 0)
            digits = np.arange(rest.shape[1]) * (maxent.REST // rest.shape[1])
            n = len(numbers)
            # every word after the same two words, in a text by itself
            hashes = np.tile(np.array([11, 12, 13], np.uint64), n)
            at = np.arange(n) * 3 + 2
            all_numbers, all_places = np.full(3 * n, shared), np.full(3 * n, other)
            all_numbers[at], all_places[at] = numbers, place
            words = maxent.Words(all_numbers, hashes, all_places, at + 1, at[missing], digits)
            weights = np.zeros((maxent.FEATURES, maxent.SUBS), np.float32)
            for moved in (0.0, 0.5):
                model = maxent.Model(*[None] * 4, weights + rng.normal(0, moved, weights.shape).astype(np.float32))
                got = model.word_log_probabilities(tree, words)[at]
                assert abs(np.exp(got).sum() - 1) < 1e-4
                if not moved:  # without contexts: smoothed shares
                    mass = np.append(counts[:shared] + 0.5, rest[place])
                    assert np.allclose(np.exp(got), mass / mass.sum(), rtol=1e-4)


def test_lm_run_sums():
    rng = np.random.default_rng(6)
    rows = rng.normal(0, 1, (500, 4)).astype(np.float32)
    lengths = np.array([1, 300, 2, 8, 9, 48, 49, 3, 1])
    starts = np.cumsum(lengths) - lengths
    at = rng.integers(0, 500, lengths.sum())
    order, sums = maxent.run_sums(rows, at, starts)
    assert sorted(order) == list(range(len(lengths)))
    for run, total in zip(order, sums, strict=True):
        assert np.allclose(total, rows[at[starts[run] : starts[run] + lengths[run]]].astype(float).sum(axis=0), atol=1e-4)


def test_lm_distribution_sums_to_one(spark):
    words = [f"word{i}".encode() for i in range(60)] + [maxent.END]
    counts = np.arange(61, 0, -1)
    mass = np.zeros((maxent.CLASSES, maxent.SUBS))
    mass[maxent.ALONE :] = 0.5
    places = [maxent.Lexicon.place(w, i) for i, w in enumerate(words)]
    for p, n in zip(places, counts.tolist(), strict=True):
        mass[p // maxent.SUBS, p % maxent.SUBS] += n + 0.5
    vocabulary = maxent.Vocabulary(words, counts, mass, int(counts.sum()), len(words))
    start = maxent.Model.start(vocabulary)
    rng = np.random.default_rng(3)
    model = maxent.Model(*[x + rng.normal(0, 0.3, x.shape).astype(np.float32) for x in (start.class_bias, start.class_weights, start.sub_bias, start.sub_weights)])
    lexicon = maxent.Lexicon(vocabulary)
    context = lexicon.hashes[[4, 9]]
    total = 0.0
    share = {p: 0.5 if p // maxent.SUBS >= maxent.ALONE else 0.0 for p in range(maxent.CLASSES * maxent.SUBS)}  # the unknown words of a sub-class
    for p, n in zip(places, counts.tolist(), strict=True):
        share[p] += n + 0.5
    for p, weight in share.items():
        if weight:
            found = model.log_probabilities(np.append(context, np.uint64(7)), np.array([3]), np.array([0, 0, p]))[2]
            total += np.exp(found) * weight / mass[p // maxent.SUBS, p % maxent.SUBS]
    assert abs(total - 1) < 1e-4


def test_lm_step_follows_the_gradient():
    rng = np.random.default_rng(5)
    bias, weights = rng.normal(0, 0.1, (3, 5)).astype(np.float32), rng.normal(0, 0.1, (20, 5)).astype(np.float32)
    group, active, wanted = rng.integers(0, 3, 40), rng.integers(0, 20, (40, 3)), rng.integers(0, 5, 40)
    model = maxent.Softmax(bias, weights)
    model.step(group, active, wanted)
    slope = {"bias": np.zeros((3, 5)), "weights": np.zeros((20, 5))}
    for g, rows, w in zip(group, active, wanted, strict=True):
        scores = bias[g].astype(float) + sum(weights[r].astype(float) for r in rows)
        p = np.exp(scores - scores.max())
        p = -p / p.sum()
        p[w] += 1
        slope["bias"][g] += p / 40
        for r in rows:
            slope["weights"][r] += p / 40
    for now, before, s in ((model.bias, bias, slope["bias"]), (model.weights, weights, slope["weights"])):
        assert np.allclose(now, before + maxent.RATE * s / (np.abs(s) + 1e-6), atol=2e-3)


def test_lm_tables_grow_with_the_input():
    assert maxent.feature_rows(10) < maxent.feature_rows(10**9) < maxent.feature_rows(10**10) <= maxent.MOST_FEATURES
    assert maxent.feature_rows(10**15) == maxent.MOST_FEATURES


def test_lm_rare_words_come_from_the_table(frame, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(40))) for i in range(30)] + [(40, "w1 never w2"), (41, None)]
    training = F.col("doc_id") < 30
    plain = {r.id: r for r in maxent.score_texts(frame(rows), "doc_id", "text", training).collect()}
    monkeypatch.setattr(maxent, "SHARED_WORDS", 40)  # only words with many tokens go to every task
    rare = {r.id: r for r in maxent.score_texts(frame(rows), "doc_id", "text", training).collect()}
    counts = Counter(w for i, t in rows if i < 30 for w in maxent.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        words = maxent.tokens(t or "")
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        for got in (plain[i], rare[i]):
            assert (got.n_tokens, got.n_known, got.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
            assert abs(got.base_score - base) < 1e-9
            assert abs(got.score - plain[i].score) < 1.0 + 0.02 * len(words)  # other words stand alone, the model stays close
