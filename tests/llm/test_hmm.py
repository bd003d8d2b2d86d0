import itertools
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from calendrix.llm import hmm


def small_model(states=3, symbols=5, seed=0):
    rng = np.random.default_rng(seed)
    rows = lambda *shape: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(shape))
    return hmm.Hmm(rows(states), rows(states, states), rows(states, symbols))


def by_paths(model, sequence):
    """Probability, and expected (start, moves, emits), over all state paths."""
    k, total = len(model.start), 0.0
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits)
    for path in itertools.product(range(k), repeat=len(sequence)):
        p = model.start[path[0]] * model.emits[path[0], sequence[0]]
        for a, b, s in zip(path, path[1:], sequence[1:]):
            p *= model.moves[a, b] * model.emits[b, s]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            moves[a, b] += p
        for a, s in zip(path, sequence):
            emits[a, s] += p
    return total, start / total, moves / total, emits / total


def test_recursions_match_all_paths(monkeypatch):
    rng = random.Random(1)
    sequences = [np.array([rng.randrange(5) for _ in range(n)]) for n in (1, 5, 2, 6, 1, 4)]
    model = small_model()
    want = [by_paths(model, s) for s in sequences]
    for block in (1000, 7):
        monkeypatch.setattr(hmm, "BLOCK", block)
        assert hmm.log_likelihoods(model, sequences) == pytest.approx([math.log(w[0]) for w in want])
        for got, n in zip(hmm.expected_counts(model, sequences), (1, 2, 3)):
            assert got == pytest.approx(sum(w[n] for w in want))


def test_sequence_probabilities_sum_to_one():
    model = small_model(2, 3)
    lengths = [np.array(s) for s in itertools.product(range(3), repeat=4)]
    assert np.exp(hmm.log_likelihoods(model, lengths)).sum() == pytest.approx(1.0)


def corpus():
    rng = random.Random(2)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("a", "ö", "z")]
    rows = []
    for i in range(300):
        words = tongues[i % 3]
        rows.append((i, " ".join(rng.choice(words[: rng.choice([5, 40])]) for _ in range(rng.choice([0, 3, 30]))).title()))
    return [*rows, (300, None), (301, ""), (301, ""), (None, "A1 unseen\nwords here"), (302, "zz9 " * 500)]


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS score")
    got = hmm.score(docs, states=3, vocabulary=30).collect()
    assert len(got) == len(rows)
    tokens = lambda t: [w.encode().lower() for w in (t or "").split()] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((str(i), held(i), len(own), sum(w in counts for w in own), n, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    long = [r for r in got if r.held_out and r.n_tokens > 20]
    assert len(long) > 5 and sum(r.score for r in long) > sum(r.base_score for r in long)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def plain_score(text, model, frequent, counts):
    """log10 of the forward probability of a text's symbols, times its rare words' shares of their classes."""
    symbols, share = [], 0.0
    for w in (text or "").encode().lower().split():
        if w in frequent:
            symbols.append(1 + hmm.CLASSES + frequent.index(w))
        else:
            own = hmm.word_class(w.decode())
            others = [x for x in counts if x is not None and x not in frequent and hmm.word_class(x.decode()) == own]
            share += math.log10((counts[w] + 0.5) / (sum(counts[x] for x in others) + 0.5 * (len(others) + 1)))
            symbols.append(1 + own)
    total, states = 0.0, range(len(model.start))
    alpha = [model.start[k] for k in states]
    for t, x in enumerate([*symbols, 0]):
        if t:
            alpha = [sum(alpha[j] * model.moves[j, k] for j in states) for k in states]
        alpha = [a * model.emits[k, x] for k, a in enumerate(alpha)]
        total += math.log10(sum(alpha))
        alpha = [a / sum(alpha) for a in alpha]
    return total + share


@pytest.mark.parametrize("part", [500, 3])
def test_score_is_the_forward_probability_times_class_shares(spark, monkeypatch, part):
    rows, told = corpus(), []
    sent = hmm.sent
    monkeypatch.setattr(hmm, "sent", lambda spark, value: told.append(value) or sent(spark, value))
    monkeypatch.setattr(hmm, "SLICE", part)
    monkeypatch.setattr(hmm, "FLUSH", 10 * part)
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=3, vocabulary=30).collect()
    model = told[-1][0]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in rows if not held(i) for w in [*(t or "").encode().lower().split(), None])
    frequent = [w for w, _ in sorted(((w, c) for w, c in counts.items() if w is not None), key=lambda x: (-x[1], x[0]))[:30]]
    want = sorted((str(i), round(plain_score(t, model, frequent, counts), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_vocabulary_fits_its_symbols(spark):
    with pytest.raises(ValueError):
        hmm.score(spark.createDataFrame([(1, "a")], "doc_id long, text string"), vocabulary=65_500)


def test_all_texts_of_one_word_sum_to_at_most_one(spark):
    """Known one-word texts, and one stand-in for each class's unseen words, are parts of a whole."""
    rows = [(i, w) for i, w in enumerate(["a", "b", "b", "cc", "dd", "dd", "a", "b"] * 6)]
    probes = [(1000 + i, w) for i, w in enumerate(["", "a", "b", "cc", "dd", "unseen"])]
    got = {r.doc_id: r.score for r in hmm.score(spark.createDataFrame(rows + probes, "doc_id long, text string"), 2, 2).collect()}
    total = sum(10 ** got[i] for i, _ in probes)
    assert 0.3 < total <= 1.0


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(docs).isEmpty()
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = hmm.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 3, 0, 0)


def test_one_long_text_needs_the_memory_of_a_span(monkeypatch):
    """Counts of spans along time are those of the whole text, and what is held does not grow with it."""
    model, rng = small_model(4, 50), np.random.default_rng(1)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in (700, 3, 1, 90, 2500)]
    whole = hmm.expected_counts(model, texts)
    for block in (7, 64, 1000):
        monkeypatch.setattr(hmm, "BLOCK", block)
        for a, b in zip(whole, hmm.expected_counts(model, texts)):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(hmm, "BLOCK", 5000)
    peaks = []
    for n in (20_000, 80_000):
        text = rng.integers(0, 50, n).astype(np.uint16)
        tracemalloc.start()
        hmm.expected_counts(model, [text])
        peaks.append(tracemalloc.get_traced_memory()[1] - 30 * n)  # the text, its times and what makes them
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] + 100_000
