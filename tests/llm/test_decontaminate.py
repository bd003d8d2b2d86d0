import random
import tracemalloc

import numpy as np
import pytest

from calendrix.llm import decontaminate as d


def words(rng, n):
    return [rng.choice(["the", "an", "of", "re"]) + "".join(rng.choice("aeiourst") for _ in range(rng.randint(1, 6))) for _ in range(n)]


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(1, len(text) - 1)
        rng.choice([lambda: text.insert(i, "z"), lambda: text.pop(i), lambda: text.__setitem__(i, "q")])()
    return "".join(text)


def plain_best(item, text):
    """Least edits of item against any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_against_full_alignment(spark):
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, rng.choice([12, 25, 40]))).capitalize() + ".") for i in range(8)]
    rows = []
    for i in range(40):
        text = " ".join(words(rng, rng.choice([5, 60])))
        if i % 2:
            leak = edited(rng, items[i % 8][1], rng.choice([0, 0, 1, 3, 8, 20]))
            text = f"{text}\n{leak.upper() if i % 3 else leak} {text}"
        rows.append((i, text))
    rows += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start")
    short = [(i, d.normalise(rows[i][1])[:n].strip()) for i, n in ((0, 4), (2, 9), (4, 15), (6, 17), (8, 22), (10, 30), (12, 43), (14, 62))]
    items += [(60 + i, text) for i, text in short]
    benchmark = spark.createDataFrame([*items, (50, None), (52, ""), (53, " .")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in d.find_leaks(docs, benchmark).collect())
    want = []
    for doc_id, text in rows:
        for item_id, item in items:
            clean = d.normalise(item)
            if len(clean) < d.Q:
                n = 0 if f" {clean} " in f" {d.normalise(text or '')} " else 1
            else:
                n = plain_best(clean, d.normalise(text or ""))
            if n <= int(0.05 * len(clean)):
                want.append((doc_id, item_id, n))
    assert got == sorted(want) and len({n for *_, n in want}) > 2
    few = sorted((r.doc_id, r.item_id, r.edits) for r in d.find_leaks(docs, benchmark, max_grams=200).collect())
    assert few == got
    for grams in (200, d.MAX_GRAMS):
        kept = d.without_leaks(docs, benchmark, grams)
        assert kept.schema == docs.schema
        assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, *_ in want}


def test_long_texts_in_windows(monkeypatch):
    rng = random.Random(5)
    item = d.normalise(" ".join(words(rng, 30)))
    index = d.Index([(7, item)])
    text = " ".join(words(rng, 300)) + " " + item + " " + " ".join(words(rng, 300))
    want = d.leaks_of([text], index)
    for chunk in (100, 333, 1000):
        monkeypatch.setattr(d, "CHUNK", chunk)
        assert d.leaks_of([text, "", text], index) == [*want, (2, *want[0][1:])]
    assert text[want[0][3] - len(item) : want[0][3]] == item


@pytest.mark.parametrize("hits", [50, 4000])
def test_slices_of_hits_change_nothing(monkeypatch, hits):
    rng = random.Random(6)
    texts = ["ha" * 300, "ha" * 40 + "x" + "ha" * 90, " ".join(words(rng, 80)), "ab" * 200 + "ha" * 50]
    index = d.Index([(1, "ha" * 40), (2, "ha" * 20 + "x" + "ha" * 20), (3, texts[2][50:200]), (4, "ab" * 30)])
    want = sorted(d.leaks_of(texts, index))
    for row, number, _, end, n in want:
        assert n == plain_best("".join(map(chr, index.items[number])), texts[row]) and 0 < end <= len(texts[row])
    assert len(want) >= 7
    monkeypatch.setattr(d, "HITS", hits)
    assert sorted(d.leaks_of(texts, index)) == want


@pytest.mark.parametrize("times, items, want", [(500_000, ["ha" * 90], [(0, 180, 0)]), (40_000, ["ha" * 45 + "x" + "ha" * 45], [(0, 180, 1)])])
def test_repetitive_text_needs_bounded_memory(times, items, want):
    index = d.Index(list(enumerate(items)))
    tracemalloc.start()
    found = d.leaks_of(["ha" * times], index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(max(0, end - 180), end, n) for *_, end, n in found] == want
    assert peak < 200e6


def test_rows_are_judged_one_by_one(spark):
    leak = "the whole passage of this benchmark item stands here"
    docs = spark.createDataFrame([(1, f"see {leak}"), (1, "clean"), (None, leak), (None, None)], "doc_id long, text string")
    kept = d.without_leaks(docs, spark.createDataFrame([(5, leak)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "clean"), ("None", "None")]


@pytest.mark.parametrize("seed", range(5))
def test_banded_distance(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("ab") for _ in range(12))
    region = "x" * rng.randint(0, 3) + edited(rng, item, 2) + "y" * rng.randint(0, 3)
    points = [np.array(list(map(ord, s))) for s in (item, region)]
    found, _ = d.banded_distance(*points, -12, 12, 5)
    assert found == min(6, plain_best(item, region))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_leaks(docs, none).isEmpty() and d.without_leaks(docs, none).count() == 1
    assert d.find_leaks(docs.limit(0), spark.createDataFrame([(1, "word " * 30)], "item_id long, text string")).isEmpty()
