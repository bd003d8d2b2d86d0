import math
import random
import zlib
from collections import Counter

import numpy as np

from calendrix.llm import toxicity

BAD = ["vlorg", "snüddel", "GRUMPF"]


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "éa") for b in ("n", "s", "ra", "pid", "lo")]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [rng.choice(words) for _ in range(rng.choice([8, 40, 200]))], i % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS y", "3 AS code")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(i % 5 == 0, r.predicted) for i, r in got.items() if r.held_out]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(p for toxic, p in held if not toxic) == 0
    assert sum(p for toxic, p in held if toxic) >= 0.95 * sum(toxic for toxic, _ in held)
    kept = toxicity.without_toxic(docs, model)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def plain_scores(rows, labels, n_features):
    """Scores by a dense naive-Bayes-scaled logistic regression, solved by Newton's method."""
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    text, y = dict(rows), {i: t for i, t in labels if not held(i)}
    grams = lambda t: {s[i : i + n] for s in [f" {' '.join(t.lower().split())} "] for n in (4, 5, 6) for i in range(len(s) - n + 1)}
    own = {i: grams(t) for i, t in rows}
    pos, neg = (Counter(g for i in y if y[i] == c for g in own[i]) for c in (1, 0))
    n1, n0 = sum(y.values()), len(y) - sum(y.values())
    ratio = {g: math.log((pos[g] + 1) / (n1 + 2)) - math.log((neg[g] + 1) / (n0 + 2)) for g in pos | neg if pos[g] + neg[g] >= 3}
    gain = {g: abs(pos[g] / n1 - neg[g] / n0) * abs(r) for g, r in ratio.items()}
    best = sorted(gain, key=lambda g: -gain[g])
    assert gain[best[n_features - 1]] > gain[best[n_features]]  # no tie at the edge
    best = best[:n_features]
    x = lambda ids: np.array([[ratio[g] * (g in own[i]) for g in best] + [1.0] for i in ids])
    back = [i for i in y if zlib.crc32(text[i].encode()) % 5 == 4]
    fit = [i for i in y if i not in set(back)]
    target, design, w = np.array([y[i] for i in fit]), x(fit), np.zeros(n_features + 1)
    ridge = np.diag([0.05] * n_features + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ w))
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(w)), design.T @ (p - target) + ridge @ w)
    slope, shift = toxicity._platt(x(back) @ w, np.array([y[i] for i in back]))
    return dict(zip(own, 1 / (1 + np.exp(-(slope * (x(own) @ w) + shift)))))


def noisy_corpus():
    """Toxic words in a few other documents and missing from a few toxic ones, so that no weight runs away."""
    rng = random.Random(11)
    rows, labels = corpus(600)
    rows = [(i, t + (f" {rng.choice(BAD)}" if rng.random() < 0.15 else "")) for i, t in rows]
    return rows, [(i, 1 - y if rng.random() < 0.08 else y) for i, y in labels]


def test_scores_match_a_plain_regression(spark):
    rows, labels = noisy_corpus()
    want = next(w for n in range(25, 60) if (w := _untied(rows, labels, n)))
    n_features, scores = want
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), features=n_features)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert max(abs(got[i] - scores[i]) for i in got) < 0.03
    assert len({round(x, 2) for x in got.values()}) > 5


def _untied(rows, labels, n):
    try:
        return n, plain_scores(rows, labels, n)
    except AssertionError:
        return None


def test_sample_keeps_its_bound_with_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = toxicity._sample(docs, labels, 2).collect()
    assert len(rows) == 4 and sorted(r.y for r in rows) == [0, 0, 1, 1]


def test_features_are_of_characters_not_bytes():
    found = {n: len(codes[toxicity._inside(data, n)]) for data, _ in toxicity._chunks(["ÉÀü🙂漢字"]) for n, codes in toxicity._codes(data)}
    assert found == {4: 5, 5: 4, 6: 3}  # of 8 characters with the spaces beside the text


def test_labels_of_held_out_rows_change_nothing(spark):
    rows, labels = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    assert np.array_equal(models[0].codes, models[1].codes) and np.allclose(models[0].weights, models[1].weights)


def test_features_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"w{i} vlorg" for i in range(300))
    codes = np.unique(np.concatenate([c[toxicity._inside(data, n)] for data, _ in toxicity._chunks([text]) for n, c in toxicity._codes(data)])[::7])
    model = toxicity.Model(codes, np.ones(len(codes)), 0.0)
    whole = [x.tolist() for x in model.features([text, "", "none", text])]
    monkeypatch.setattr(toxicity, "CHUNK", 50)
    assert [x.tolist() for x in model.features([text, "", "none", text])] == whole
    assert set(whole[0]) == {0, 3}


def test_nulls_repeats_and_missing_classes(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "vlorg"), (4, "x" * 9000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == 5 and all(r.score == 0.0 and r.predicted == 0 and r.held_out is not None for r in rows)
    rows, labels = corpus(100)
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs.where("doc_id = 2"), model).collect()] == [0, 0]
    assert toxicity.score(docs.limit(0), model).isEmpty()
    assert toxicity.without_toxic(docs, model).count() >= 4
