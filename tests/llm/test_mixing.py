import hashlib
import math
from collections import Counter

import pytest

from calendrix.llm import mixing


def plain_copies(rate, doc_id, seed=17):
    pieces, total = max(1, math.ceil(rate / 16)), 0
    for i in range(1, pieces + 1):
        u = int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        lam = rate / pieces
        p = c = math.exp(-lam)
        k = 0
        while c <= u and k < 79:
            k += 1
            p = p * lam / k
            c += p
        total += k
    return total


def rows():
    out = [(i, "t" * (1 + i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    return [*out, (900, None, None), (901, "", "tiny"), (901, "", "tiny"), (None, "no id", "big")]


def test_matches_brute_force_with_and_without_broadcast(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string").selectExpr("*", "5 AS copy_no", "1 AS rate", "2 AS weight")
    size = Counter()
    for _, t, s in rows():
        size[s] += max(len(t or ""), 1)
    weight = {s: {"big": 0.5, "s3": 4.0}.get(s, 1.0) for s in size}
    want = Counter()
    for i, _, s in rows():
        rate = weight[s] / sum(weight.values()) * (2.0 * sum(size.values())) / size[s]
        want[i, s] += plain_copies(rate, i)
    for bound in (100, 2):
        mixed = mixing.mix(docs, {"big": 0.5, "s3": 4.0}, epochs=2.0, broadcast_rows=bound)
        assert mixed.columns == ["doc_id", "text", "source", "rate", "weight", "copy_no", "mix_key"]
        got = mixed.collect()
        assert Counter((r.doc_id, r.source) for r in got) == +want
    assert sum(len(r.text or "") for r in got if r.source == "s3") > 2 * sum(len(r.text or "") for r in got if r.source == "s4")


HELPERS = ["own_source", "pieces", "table", "salt", "their_salt", "copies", "rate", "weight", "size", "n", "all_weights", "_n", "_table", "_source"]


@pytest.mark.parametrize("bound", [100, 1])
def test_columns_of_any_name_come_back_unchanged(spark, bound):
    docs = spark.createDataFrame([(i, "t", f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string")
    named = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in HELPERS])
    got = mixing.mix(named, {"s1": 2.0}, broadcast_rows=bound)
    assert got.columns == [*named.columns, "copy_no", "mix_key"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in mixing.mix(docs, {"s1": 2.0}).collect())
    assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in HELPERS)


def test_counts_are_poisson(spark):
    docs = spark.createDataFrame([(i, "x", "a") for i in range(4000)], "doc_id long, text string, source string")
    counts = Counter(r.doc_id for r in mixing.mix(docs, {}, epochs=3.0).collect())
    values = [counts[i] for i in range(4000)]
    mean = sum(values) / 4000
    assert abs(mean - 3) < 0.15 and abs(sum((v - mean) ** 2 for v in values) / 4000 - 3) < 0.3
    assert mixing.mix(docs.limit(0), {}).isEmpty()
    assert mixing.mix(docs, {"a": 0.0}).isEmpty()
