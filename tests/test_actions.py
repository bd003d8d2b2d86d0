"""Ordered actions and verdicts against a plain loop over them."""

import random

import pytest
from pyspark.sql import functions as F

from calendrix.operators import folds, monitoring

KINDS = ["deactivate_query", "create_query", "create_source_query", "boost_query", "flag_source"]
ACTIONS = "report long, pos long, type string, query_text string"


def plain_queries(known, actions):
    """{text: (is_active, priority, type, by)} and {(report, pos): known}, one action after the other."""
    state, met = {t: [a, p, "event_search", "user"] for t, a, p in known}, {}
    for report, pos, kind, text in sorted(actions, key=lambda a: a[:2]):
        if not text or kind == "flag_source":
            continue
        met[report, pos] = text in state
        if kind == "deactivate_query" and text in state:
            state[text][0] = False
        elif kind == "boost_query" and text in state and state[text][0]:
            state[text][1] = 0.8
        elif kind.startswith("create") and text not in state:
            source = kind == "create_source_query"
            state[text] = [True, 1.0 if source else 0.7, "source_discovery" if source else "event_search", "agent"]
    return {t: tuple(s) for t, s in state.items()}, met


@pytest.mark.parametrize("texts", [2, 40])
def test_actions_follow_each_other(spark, texts):
    """With two texts, each spans many tasks."""
    rng = random.Random(texts)
    known = [(f"q{i}", rng.random() < 0.7, rng.random()) for i in range(0, texts, 2)]
    actions = [(n // 8, n, rng.choice(KINDS), None if rng.random() < 0.05 else f"q{rng.randrange(texts)}") for n in range(1500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    asked = monitoring.first_actions(spark.createDataFrame(actions, ACTIONS).repartition(6))
    queries = spark.createDataFrame([(*k, "event_search", "user") for k in known], "query_text string, is_active boolean, priority double, query_type string, created_by string")
    met, after = monitoring.folded_queries(asked, queries)
    got = {(r.report, r.pos): r.known for r in met.collect()}
    done = {r.query_text: (r.is_active, r.priority, r.query_type, r.created_by) for r in monitoring.acted_queries(queries, after).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = [a for a in actions if a[1] % 8 < 5]
    want, known_then = plain_queries(known, first)
    assert got == known_then and done == want


def test_clashing_actions(spark):
    rows = [(1, 1, "create_query", "new"), (1, 2, "create_query", "new"), (1, 3, "boost_query", "old"), (1, 4, "deactivate_query", "old"), (1, 5, "create_source_query", "gone"),
            (1, 6, "boost_query", "new"), (2, 1, "deactivate_query", "gone"), (2, 2, "boost_query", "gone"), (2, 3, "create_query", "gone")]
    asked = monitoring.first_actions(spark.createDataFrame(rows, ACTIONS))
    queries = spark.createDataFrame([("old", True, 0.5, "event_search", "user")], "query_text string, is_active boolean, priority double, query_type string, created_by string")
    met, after = monitoring.folded_queries(asked, queries)
    assert {(r.report, r.pos): r.known for r in met.collect()} == {(1, 1): False, (1, 2): True, (1, 3): True, (1, 4): True, (1, 5): False, (2, 1): True, (2, 2): True, (2, 3): True}
    got = {r.query_text: (r.is_active, r.priority, r.query_type) for r in monitoring.acted_queries(queries, after).collect()}
    assert got == {"new": (True, 0.7, "event_search"), "old": (False, 0.8, "event_search"), "gone": (False, 1.0, "source_discovery")}


def test_the_last_verdict_sets_the_status(spark):
    items = spark.createDataFrame([(1, "proposed", False), (2, "proposed", False), (3, "proposed", False)], "id long, repair_status string, is_resolved boolean")
    repairs = spark.createDataFrame([(10, 1, None, None), (11, 1, None, None), (20, 2, None, None), (30, None, None, None)], "id long, action_item_id long, verification_result string, verified_at timestamp")
    said = spark.createDataFrame([(10, "verified", 1), (11, "failed", 2), (20, "failed", 1), (20, "verified", 3), (30, "failed", 4)], "repair_id long, result string, pos long")
    done, judged = monitoring.verified_repairs(items, repairs, said, F.lit("2026-01-05").cast("timestamp"))
    assert {r.id: (r.repair_status, r.is_resolved) for r in done.collect()} == {1: ("failed", True), 2: ("verified", True), 3: ("proposed", False)}
    assert {r.id: r.verification_result for r in judged.collect()} == {10: "verified", 11: "failed", 20: "verified", 30: "failed"}


def test_folded_takes_unknown_steps_and_empty_tables(spark):
    moves = {"up": (1, 2, 2), "off": (0, 0, 0)}
    steps = spark.createDataFrame([("a", 1, "up"), ("a", 2, "what"), ("a", 3, "up"), ("b", 1, "off"), (None, 1, "up")], "key string, at long, step string")
    start = spark.createDataFrame([("b", 2), ("c", 1)], "key string, state int")
    out, final = folds.folded(steps, ["at"], moves, start, 3)
    assert {(r.key, r.at): (r.state_before, r.state_after) for r in out.collect()} == {("a", 1): (0, 1), ("a", 2): (1, 1), ("a", 3): (1, 2), ("b", 1): (2, 0)}
    assert {r.key: r.state for r in final.collect()} == {"a": 2, "b": 0, "c": 1}
    assert folds.folded(steps.limit(0), ["at"], moves, start, 3)[1].count() == 2
