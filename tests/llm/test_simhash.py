import random
from itertools import combinations

import pytest
import xxhash

from calendrix.llm import simhash
from calendrix.llm.components import connected_components


def plain_simhash(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=4):
    root = {i: i for i, _ in values}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, x), (j, y) in combinations(values, 2):
        if (x ^ y).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i, _ in values}


def test_masks_cover_every_pair_within_the_radius():
    masks = [m % (1 << 64) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    for bits in combinations(range(64), 4):
        flip = sum(1 << b for b in bits)
        assert any(m & flip == 0 for m in masks)


def sample_docs():
    rng = random.Random(7)
    words = ["ab", "Cd", "éÉ", "xyz", "Qq", "lorem", "ip", "sum", "da", "ta"]
    rows = []
    for i in range(150):
        text = [rng.choice(words) + rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 60]))]
        for k in range(rng.choice([1, 1, 3])):
            copy = list(text)
            if copy and k:
                copy[rng.randrange(len(copy))] = "Edit"
            rows.append((len(rows) * 3, rng.choice(["\n", " ", "\t "]).join(copy)))
    return [*rows, (9001, None), (9002, ""), (9003, "w " * 300), (9003, "w " * 300), (9004, "ONE two")]


@pytest.mark.parametrize("bucket", [4096, 2])
def test_query_matches_brute_force(spark, bucket):
    rows = sample_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnsRenamed({}).selectExpr("*", "1 AS fingerprint", "2 AS component")
    got = sorted(map(tuple, simhash.near_duplicates(docs, bucket=bucket).collect()))
    prints = [(i, plain_simhash(t)) for i, t in rows]
    groups = plain_components(sorted(set(prints)))
    assert got == sorted((i, f"{x:016x}", groups[i]) for i, x in prints)
    assert 1 < len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("radius", [2, 3])
def test_midpoints_give_the_components_of_all_pairs(spark, radius):
    rng = random.Random(radius)
    values = sorted({sum(1 << b for b in rng.sample(range(12), 5)) for _ in range(40)})
    links = simhash._by_midpoints(spark.createDataFrame([(v,) for v in values], "x long"), radius)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert {v: got.get(v, v) for v in values} == plain_components([(v, v) for v in values], radius)


def test_every_bucket_is_searched_as_a_whole(spark):
    """fingerprints that meet in one bucket of three only, where Spark plans a sorted join and then takes a
    broadcast, as it does for large tables."""
    rng = random.Random(1)
    values = []
    for base in (rng.getrandbits(62) for _ in range(40)):
        bits = rng.sample(range(30), 4)
        # Bits 31 apart are in the same masks.
        values += [base, base ^ sum(1 << b for b in bits), base ^ sum(1 << b + 31 for b in bits)]
    values = sorted(set(values))
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        nodes = spark.createDataFrame([(v,) for v in values], "x long").repartition(8)
        got = {(r.a, r.b) for r in simhash.links(nodes).collect()}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    joined = {r.node: r.component for r in connected_components(spark.createDataFrame(sorted(got), "a long, b long")).collect()}
    assert {v: joined.get(v, v) for v in values} == plain_components([(v, v) for v in values])


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 560)] + [(7, 7), (900, 900), (None, 3)] + [(500, 501)] * 3
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(500, 560), 500)}


def test_one_of_each_group_stays(spark):
    text = "a b c d e f g h i j"
    rows = [(5, text), (3, text), (3, text), (8, "other words here now"), (None, text), (9, None), (11, "")]
    kept = simhash.keep_one_per_group(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id) == [3, 8, 9]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.keep_one_per_group(empty).isEmpty()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (0, 1, 3, 4, 5, 64, 65, 3000)]
    whole = [simhash.simhash(t) for t in texts]
    for chunk in (1, 7, 64):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        assert [simhash.simhash(t) for t in texts] == whole


def test_large_ids_stay_whole_beside_null_ones(spark):
    big = 2**53 + 1
    rows = [(None, "no id at all here"), (big, "one two three four five"), (big + 1, "ONE two three four five"), (2**63 - 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, None), (big, big), (big + 1, big), (2**63 - 1, 2**63 - 1)}
