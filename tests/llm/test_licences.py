import random
import textwrap

import numpy as np
import pytest
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import functions as F

from calendrix.llm import licences


LINES = [t for own in licences.TEXTS.values() for t in own]


@pytest.fixture(scope="module")
def corpus(spark):
    """A plain document for each licence paragraph, which is planted in it, and some without any."""
    rng = random.Random(3)
    rows, planted = [], {}
    for i in range(len(LINES) + 100):
        body = [" ".join(rng.choice("the of and on en thing re der er with ation la".split()) for _ in range(rng.randint(4, 40))) for _ in range(3)]
        if i < len(LINES):
            at = rng.randrange(3)
            body.insert(at, LINES[i].upper() if i % 2 else LINES[i])
            planted[i, at] = LINES[i]
        rows.append((i, "\n".join(body)))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "The licence of the thing is not known."), (904, "en thing of the " * 20_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS paragraph", "2 AS words", "3 AS family"), planted


@pytest.fixture(scope="module")
def model(corpus):
    return licences.train(corpus[0])


def test_planted_paragraphs_are_found_and_nothing_else(corpus, model):
    docs, planted = corpus
    rows = licences.scan(docs, model).collect()
    found = {(r.doc_id, r.paragraph): r for r in rows if r.confirmed}
    assert set(found) == set(planted), [(planted.get(k) or "none")[:90] for k in set(found) ^ set(planted)]
    # A paragraph that several families have may be found as any of them.
    wrong = [(r.family, planted[k][:60]) for k, r in found.items() if planted[k] not in licences.TEXTS[r.family]]
    assert len(wrong) <= 0.02 * len(planted), wrong
    assert all(0 < r.probability <= 1 and r.similarity >= 0.8 for r in found.values())
    assert len(licences.TEXTS) >= 14


def test_wrapped_and_changed_texts_are_found(spark, model):
    whole = [*textwrap.wrap(licences.TEXTS["MIT"][2], 78), *textwrap.wrap(max(licences.TEXTS["BSD-3-Clause"], key=len), 78)]
    changed = [t.replace("copyright", "copy right").replace("software", "program") for t in licences.TEXTS["Apache-2.0"] if len(t.split()) > 30]
    rows = [(i, t) for i, t in enumerate([*whole, *changed]) if len(t.split()) >= 8]
    got = {r.doc_id for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert len(got) >= 0.9 * len(rows)


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def test_probabilities_match_a_plain_softmax(spark, model):
    texts = [licences.TEXTS["MIT"][2], licences.TEXTS["GPL-3.0"][5], "the of and thing en re", "Licensed under the MIT License, thing and all", "x"]
    rows = spark.createDataFrame([(i, plain_words(t)) for i, t in enumerate(texts)], "doc_id long, words array<string>")
    got = {r.doc_id: r for r in model.probabilities(rows).collect()}
    place = {g: i for i, g in enumerate(model.vocabulary.vocabulary)}
    weights, bias = model.regression.coefficientMatrix.toArray(), model.regression.interceptVector.toArray()
    for i, text in enumerate(texts):
        words = plain_words(text)
        own = {place[g] for k in (2, 3) for n in range(len(words) - k + 1) if (g := " ".join(words[n : n + k])) in place}
        margin = bias + weights[:, sorted(own)].sum(axis=1)
        p = np.exp(margin - margin.max())
        p /= p.sum()
        assert got[i].licence_p == pytest.approx(1 - p[-1], abs=1e-9) and got[i].best == int(p[:-1].argmax())


def test_similarity_matches_brute_force(spark, model):
    text = "Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and more files, to deal in it"
    got = licences.scan(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"), model).collect()
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    own = cut(plain_words(text))
    want = max(len(own & cut(plain_words(t))) / min(len(own), len(cut(plain_words(t)))) for t in licences.TEXTS[got[0].family])
    assert got[0].family in ("MIT", "BSL-1.0") and [r.similarity for r in got] == [pytest.approx(want)] * 2


def test_every_line_counts(spark, monkeypatch):
    """the unknown class is learnt from all lines, repeats included; alike ones are one row with its weight."""
    lines = [f"the word{i} of the thing{i}" for i in range(6000)] + ["to the and of"] * 50 + ["the License of none", licences.TEXTS["MIT"][2]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = []
    whole = licences._unknown
    monkeypatch.setattr(licences, "_unknown", lambda *a: got.append(whole(*a)) or got[-1])
    licences.train(docs, {"MIT": licences.TEXTS["MIT"]})
    rows = got[0].collect()
    assert sum(r.n for r in rows) == 6050 and len(rows) < 100
    assert 1500 < sum(r.n for r in rows if r.back) < 2500


def test_only_n_grams_of_the_texts_are_made(spark):
    """a line's n-grams with other words are never made; the rest are those of the whole list, repeats included."""
    lines = ["the cat of the mat of the", "of the", "cat", "", "mat the cat of cat of the mat", "x y z"]
    rows = spark.createDataFrame([(plain_words(t),) for t in lines], "words array<string>")
    of = ["the", "of", "mat"]
    got = rows.select(licences.grams(F.col("words"), of).alias("some"), licences.grams(F.col("words")).alias("all")).collect()
    assert all(sorted(r.some) == sorted(g for g in r.all if set(g.split()) <= set(of)) for r in got)
    assert sorted(got[0].some) == ["mat of", "mat of the", "of the", "of the", "of the mat", "the mat", "the mat of"]


def test_lines_half_of_the_texts_are_not_unknown(spark):
    """whatever share of a line is of a text, and however often the line or its words are repeated."""
    rng, text = random.Random(4), [w for t in licences.TEXTS["MIT"][1:] for w in plain_words(t)]
    own = [w for w in sorted(set(text)) if "licen" not in w and "copyright" not in w]
    lines = []
    for _ in range(300):
        at, n = rng.randrange(len(text) - 20), rng.randint(1, 20)
        tail = [rng.choice(own + ["zebra", "yak"]) for _ in range(rng.choice([0, n // 2, n, 3 * n]))]
        lines.append(" ".join(text[at : at + n] * rng.choice([1, 1, 3]) + tail))
    lines = [t for t in lines * 2 if "licen" not in t and "copyright" not in t] + ["other words that none has"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    cut = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    known = {s for t in licences.TEXTS["MIT"] for s in cut(plain_words(t))}
    vocabulary = CountVectorizerModel.from_vocabulary(sorted({" ".join(text[i : i + k]) for k in (2, 3) for i in range(len(text) - k + 1)}), "_grams", "_features").setBinary(True)
    got = licences._unknown(docs, {"MIT": licences.TEXTS["MIT"]}, vocabulary).collect()
    want = [t for t in lines if len(cut(t.split()) & known) * 2 < len(cut(t.split()))]
    place = {g: i for i, g in enumerate(vocabulary.vocabulary)}
    sets = {}
    for t in want:
        w = t.split()
        own = tuple(sorted({place[g] for k in (2, 3) for i in range(len(w) - k + 1) if (g := " ".join(w[i : i + k])) in place}))
        sets[own] = sets.get(own, 0) + 1
    found = {}
    for r in got:
        found[tuple(r._features.indices)] = found.get(tuple(r._features.indices), 0) + r.n
    assert found == sets and 20 < len(want) < len(lines) - 20


def test_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = licences.train(none)
    assert licences.scan(none, model).isEmpty()
    one = spark.createDataFrame([(5, "Released under the MIT License.")], "doc_id long, text string")
    assert licences.scan(one, model).first().family == "MIT"
