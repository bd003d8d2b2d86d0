import hashlib
import random
from collections import Counter

from calendrix.llm import line_dedup


def plain(rows, min_docs, min_chars=1):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: low(line.strip(" \t\n\x0b\x0c\r"))
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, own in lines for k in {key(x) for x in own} if len(k) >= min_chars)
    out = []
    for i, own in lines:
        kept = [x for x in own if seen[key(x)] < min_docs]
        out.append((i, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in df.collect()), key=str)


def rows_with_shared_lines():
    rng = random.Random(3)
    pool = ["Accept all", " accept ALL\t", "É mixed", "é mixed", "\x0bfoot\x0c", "", "  ", " foot", "x", "Long " * 40]
    rows = [(i, "\n".join(rng.choice([*pool, f"line {rng.random()}"]) for _ in range(rng.randint(1, 8)))) for i in range(60)]
    return [*rows, (60, None), (61, ""), (62, "x"), (62, "x"), (63, "\n\n"), (None, "Accept all\nmine"), (64, "a\n" * 3000)]


def test_matches_brute_force(spark):
    rows = rows_with_shared_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_lines", "'s' AS h1", "1 AS n")
    assert digest(line_dedup.drop_frequent_lines(docs)) == plain(rows, 10)
    assert digest(line_dedup.drop_frequent_lines(docs, min_docs=3, min_chars=4)) == plain(rows, 3, 4)


def test_empty_table_and_other_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.drop_frequent_lines(docs).columns == ["doc_id", "text", "source", "n_lines", "n_dropped"]
    assert line_dedup.drop_frequent_lines(docs).isEmpty()


def test_batches_meet_what_came_before(spark):
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for batch in range(5):
        docs = spark.createDataFrame([(batch, f"shared\nown {batch}")], "doc_id long, text string")
        text = runs.ingest(docs, min_docs=2).first().text
        assert text == (f"shared\nown {batch}" if batch < 2 else f"own {batch}")
    assert sum(map(len, runs.levels)) <= 3
    with line_dedup._sorted_runs(spark):
        assert {r.n for r in runs._merged(runs.runs()).collect()} == {1, 5}


def test_runs_are_not_shuffled_or_sorted_again(spark):
    runs = line_dedup.LineRuns(spark, buckets=3)
    for batch in range(2):
        docs = spark.createDataFrame([(i, f"shared\nown {batch} {i}") for i in range(40)], "doc_id long, text string")
        run = runs._run_of(line_dedup.hashed_lines(docs))
        if batch:
            before = spark.conf.get("spark.sql.unionOutputPartitioning")
            with line_dedup._sorted_runs(spark):
                met = runs._before(run)
                assert {r.seen for r in met.collect()} == {0, 40}
                plan = met._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
            assert spark.conf.get("spark.sql.unionOutputPartitioning") == before
        runs._put(run)


HELPERS = ["_text", "_hash", "_parts", "dropped_at", "l_id", "l_hash", "own_id", "own_hash", "others", "whole", "parts", "h1", "h2", "at", "hashes", "text_hash", "rare_at", "hashed_at", "batch", "n"]


def test_columns_of_any_name_come_back_unchanged(spark):
    rows = rows_with_shared_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"concat('{c}', doc_id) AS {c}" for c in HELPERS])
    out = line_dedup.drop_frequent_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert digest(out) == plain(rows, 10)
    assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in out.collect() for c in HELPERS)
