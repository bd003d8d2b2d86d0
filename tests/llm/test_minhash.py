import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from calendrix.llm import minhash


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def plain_fingerprint(text, bins=128, k=5):
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
    grams = [hashed[i : i + k] for i in range(max(1, len(hashed) - k + 1))] if hashed else []
    least = {}
    for gram in grams:
        h = 42
        for w in gram:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        b = h >> (65 - bins.bit_length())
        least[b] = min(least.get(b, h), h)
    order = minhash.probe_order(bins)
    held = [least[b if b in least else next(j for j in order[b] if j in least)] & 255 for b in range(bins)] if least else []
    return "".join(bytes(held[i : i + 8])[::-1].hex() for i in range(0, len(held), 8))


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / (len(a) // 2)
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def run(docs):
    near = minhash.compare_with_next(docs)
    return near.withColumns({c: minhash.hexed(c) for c in ("fingerprint", "edited_fingerprint")})


ROWS = [
    (7, " ".join(f"Word{i % 190}" for i in range(700))),
    (5, "one TWO three four five six seven\teight nine\n ten éÉ"),
    (4, "one"),
    (3, ""),
    (1, None),
    (-20, "one TWO three four five six seven eight nine ten éÉ 🙂🙂🙂"),
]


def test_matches_brute_force(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "1 AS rank", "2 AS prefix", "3 AS next_text")
    got = {r.doc_id: r for r in run(docs).collect()}
    texts = [t or "" for _, t in ROWS]
    for at, (doc_id, _) in enumerate(ROWS):
        text, after = texts[at], texts[(at + 1) % len(ROWS)]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        row = got[doc_id]
        assert (row.n_chars, row.edited_text) == (len(text), edited)
        assert (row.fingerprint, row.edited_fingerprint) == (plain_fingerprint(text), plain_fingerprint(edited))
        assert row.near_edited == pytest.approx(plain_likeness(row.fingerprint, row.edited_fingerprint))
        assert row.near_next == pytest.approx(plain_likeness(row.fingerprint, plain_fingerprint(after)))
        assert hashlib.sha256(edited.encode()).hexdigest() == hashlib.sha256(row.edited_text.encode()).hexdigest()


def test_likeness_is_close_to_jaccard(spark):
    a = [f"w{i}" for i in range(3000)]
    pairs = [(" ".join(a), " ".join(a[:n] + [f"x{i}" for i in range(3000 - n)])) for n in (3000, 2700, 1500, 0)]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = minhash.with_fingerprint(minhash.with_fingerprint(df, "a", "fa"), "b", "fb")
    got = [r[0] for r in df.select(minhash.likeness("fa", "fb")).collect()]
    assert got[0] == 1.0
    for value, n in zip(got[1:], (2700, 1500, 0)):
        assert abs(value - n / (6000 - n)) < 0.13


def test_ids_are_linked_across_ranges(spark):
    ids = sorted({i * i for i in range(200)}, reverse=True)
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(5)
    for most in (1000, 5):
        rows = minhash.with_next(docs, ["text"], per_range=7, most=most).collect()
        assert {r.doc_id: r.next_text for r in rows} == {i: f"t{k}" for i, k in zip(ids, [*ids[1:], ids[0]])}
        assert len(rows) == len(ids)


@pytest.mark.parametrize("ids", [[*range(3000), 10**17], [*range(500), *range(10**12, 10**12 + 500)], [f"doc-{i * i}" for i in range(900)], [7] * 300 + [9]])
def test_ranges_are_of_one_size_for_any_ids(spark, ids):
    rows = [(x, f"text {n}") for n, x in enumerate(ids)]
    docs = spark.createDataFrame(rows, f"doc_id {'string' if isinstance(ids[0], str) else 'long'}, text string").repartition(5)
    digest = dict(docs.select("text", F.xxhash64("text")).collect())
    order = sorted(rows, key=lambda r: ([*map(ord, r[0])] if isinstance(r[0], str) else r[0], digest[r[1]]), reverse=True)
    want = {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]])}
    got = minhash.with_next(docs.selectExpr("*", "text AS place", "1 AS sent", "2 AS own_key"), ["text"], per_range=50).collect()
    assert {r.text: r.next_text for r in got} == want and len(got) == len(rows)
    assert all(r.place == r.text and (r.sent, r.own_key) == (1, 2) for r in got)
    keys = docs.select("doc_id", F.xxhash64("text").alias("digest"))
    cuts = sorted((h for b in minhash._cuts(keys, 20).first().blocks for h in b), reverse=True)
    sizes = [sum(lo < (r[0], digest[r[1]]) <= hi for r in rows) for hi, lo in zip(cuts, cuts[1:])] if not isinstance(ids[0], str) else [0]
    assert len(cuts) > 5 and max(sizes) < len(rows) / 4


def test_repeated_and_null_ids_and_empty_table(spark):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "q r s"), (1, "longer text of one"), (None, "x y z")]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"))
    got = out.orderBy("doc_id", "n_chars").select("doc_id", "n_chars", "edited_text").collect()
    assert [(r.doc_id, r.n_chars) for r in got] == [(None, 5), (1, 5), (1, 18), (2, 11), (2, 11)]
    assert got[0].edited_text == "x y " and "a b c d a b" in (got[3].edited_text, got[4].edited_text)
    assert run(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    assert run(spark.createDataFrame([(1, None)], "doc_id long, text string")).select(F.col("near_next")).first()[0] == 1.0
