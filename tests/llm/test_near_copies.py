import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from calendrix.llm import near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows):
    """Doc_ids that stay, and the number of links at 0.8 to 0.95, by brute force over all pairs."""
    sets, root, loose = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}, 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(sets), 2):
        s = alike(sets[i], sets[j])
        if s >= 0.8:
            loose += s <= 0.95
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in root if find(i) == i}, loose


def sample(edits=(1, 2, 3, 5)):
    rng = random.Random(4)
    rows = []
    for _ in range(90):
        text = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 30, 50, 90, 200]))]
        for k in range(4):
            copy = list(text)
            for _ in range(rng.choice(edits) if k else 0):
                copy[rng.randrange(len(copy))] = f"edit{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (9001, None), (9002, " \n"), (9003, "one TWO"), (9004, "One two")]


@pytest.mark.parametrize("sent", [near_copies.SENT_ROWS, 0])
def test_stage_finds_copies_from_0_8_on(spark, monkeypatch, sent):
    monkeypatch.setattr(near_copies, "SENT_ROWS", sent)
    rows = sample()
    want, loose = plain_kept(rows)
    assert loose > 60 and len(want) < len(rows)
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("bucket", [512, 4])
def test_one_large_group_leaves_one(spark, bucket):
    rng = random.Random(1)
    text = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join("x" + str(i) if j == at else w for j, w in enumerate(text))) for i in range(40) for at in [rng.randrange(120)]]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket)
    assert [r.doc_id for r in got.collect()] == [0]


def test_decisions_hold_for_a_text(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, text), (5, text + " end"), (5, other), (None, other), (None, "c d e f g h"), (1, text), (7, None), (8, "")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS digest"))
    assert got.columns == ["doc_id", "text", "digest"]
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(1, text), (5, other), (0, "c d e f g h"), (7, "")])
    assert near_copies.keep_one(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


def template(n_pairs=1500, shared=60, own=40, seed=6):
    """Texts that share a template (likeness about 0.4) and come in pairs at 0.8 to 0.85."""
    rng = random.Random(seed)
    frame = [f"t{i}" for i in range(shared)]
    rows = []
    for p in range(n_pairs):
        mine = [f"p{p}w{i}" for i in range(own)]
        text = frame + mine
        rows.append((2 * p, " ".join(text)))
        edited = list(text)
        at = rng.randrange(shared + 8, len(edited) - 8)
        edited[at], edited[at + 1] = "x", "y"
        rows.append((2 * p + 1, " ".join(edited)))
    return rows


@pytest.mark.parametrize("bucket", [512, 8])
def test_a_template_hides_no_pair(spark, bucket):
    """Buckets of thousands of unlike texts, cut into hundreds of parts, lose no alike pair within them."""
    rows = template(600)
    sets = {i: plain_set(t) for i, t in rows}
    assert all(0.8 <= alike(sets[i], sets[i + 1]) <= 0.9 for i in range(0, len(rows), 2))
    assert 0.3 < alike(sets[0], sets[2]) < 0.6
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), bucket=bucket)
    assert sorted(r.doc_id for r in got.collect()) == list(range(0, len(rows), 2))


@pytest.mark.parametrize("bucket", [512, 4])
def test_blocks_find_every_link(spark, bucket):
    """One bucket of a group of copies, of unlike texts and of pairs, compared block by block."""
    rng, base = random.Random(2), [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + ["z"] + base[i + 1 :]) for i in range(40)]
    texts += [" ".join(f"u{p}v{i}" for i in range(30)) + tail for p in range(12) for tail in ("", " end")]
    texts += [" ".join(f"s{rng.randrange(10**6)}" for _ in range(9)) for _ in range(20)]
    sets = [near_copies.shingle_set(t) for t in texts]
    rows = spark.createDataFrame([(i, [int(x) for x in s.view("int64")]) for i, s in enumerate(sets)], "node long, shingles array<long>")
    found = near_copies.Links(rows, 0.8, bucket)
    one = rows.selectExpr("0 AS t", "5L AS k", "node", "size(shingles) AS size")
    found.compare_blocks(found.grouped(one))
    plain = [plain_set(t) for t in texts]
    want = {i: {i} for i in range(len(texts))}
    for i, j in combinations(range(len(texts)), 2):
        if alike(plain[i], plain[j]) >= 0.8 and want[i] is not want[j]:
            want[i] |= want[j]
            for x in want[j]:
                want[x] = want[i]
    got = {r.node: r.grp for r in found.grouped(rows.select("node")).collect()}
    assert got == {i: min(s) for i, s in want.items()}
    # With groups known beforehand: the large group is not compared within, and the rest still is.
    again = near_copies.Links(rows, 0.8, bucket)
    again.compare_blocks(one.withColumn("grp", F.when(F.col("node") < 40, 0).otherwise(F.col("node"))))
    links = [(r.a, r.b) for r in again.links.collect()]
    assert {frozenset(x) for x in links} >= {frozenset((40 + 2 * p, 41 + 2 * p)) for p in range(12)}
    assert not any(a < 40 and b < 40 for a, b in links)


def test_very_long_and_repeated_texts(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "CHUNK", 64)
    rng = random.Random(3)
    long = [f"w{rng.randrange(50_000)}" for _ in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-2000])), (3, " ".join(long[20_000:])), (4, "w " * 30_000), (5, "w " * 90), (6, " ".join(long) + " end")]
    assert near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").toPandas().doc_id.tolist() == [1, 3, 4]
