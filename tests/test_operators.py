"""Duplicates, state changes and selection against plain-Python versions on small random inputs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from calendrix.operators import dedup, lookups, selection, transitions

T0 = dt.datetime(2026, 1, 5)


def entries(seed, n=60):
    rng = random.Random(seed)
    titles = ["AI Night", "AI-Night!", "Hack day", "Data talk", "データ", ""]
    venues = ["Capital Factory", "The Grand Hall", "Grand Hall, 2nd floor", "Grand Hall", None, ""]
    rows = []
    for i in range(n):
        start = T0 + dt.timedelta(minutes=rng.choice([0, 1, 59, 60, 61, 180, 239, 240, 779, 780, 1500, 2939, 2940]) + rng.randrange(4) * 1440)
        if rng.random() < 0.15:
            start = start.replace(hour=0, minute=0)
        url, event_id = f"http://e.example/{rng.randrange(400)}", rng.choice([None, "", str(rng.randrange(90))])
        rows.append((seed * 1000 + i, rng.choice(titles), None if rng.random() < 0.05 else start, rng.choice("abc"), rng.choice(venues), None, url, event_id, rng.randrange(10**6)))
    return rows


SCHEMA = "id long, title string, start timestamp, source string, venue string, address string, url string, source_event_id string, arrival long"


def norm(s):
    return "".join(c for c in (s or "").lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")


def hours(a, b):
    return abs((a - b).total_seconds()) // 3600 if a and b else 999


def prints(row):
    parts = [norm(row[4]), norm(row[5]), norm(" ".join(x for x in row[4:6] if x))]
    return [p for p in parts if len(p) >= 6]


def overlap(a, b):
    return any(x in y or y in x for x in prints(a) for y in prints(b))


def near(a, b, most):
    if not a or not b:
        return False
    if dt.time() in (a.time(), b.time()):
        return a.date() == b.date()
    return hours(a, b) <= most


def plain_cascade(new, old, agreed):
    out, old = {}, sorted(old, key=lambda r: r[8])
    for a in new:
        same_id = [b[0] for b in old if a[3] and a[7] and (a[3], a[7]) == (b[3], b[7])]
        keyed = [b[0] for b in old if a[6] == b[6]][:1] or same_id[-1:]
        exact = [b[0] for b in old if norm(a[1]) and norm(a[1]) == norm(b[1]) and (hours(a[2], b[2]) <= 12 or (norm(a[4]) and norm(a[4]) == norm(b[4]) and hours(a[2], b[2]) <= 48))]
        same = [b[0] for b in old if a[3] == b[3] and a[2] and b[2] and a[2].date() == b[2].date()][:3]
        other = [b for b in old if a[3] != b[3] and near(a[2], b[2], 3)]
        venue = [b[0] for b in other if overlap(a, b)][:3]
        bare = [b[0] for b in other if hours(a[2], b[2]) <= 1 and (not a[4] or not b[4])][:3]
        scored = sorted((distance(a[1].lower(), b[1].lower()), b[8], b[0]) for b in old if hours(a[2], b[2]) <= 24)
        fuzzy = [i for s, _, i in scored if s <= 0.4][:3]
        hits = [(0, i) for i in keyed] + [(1, i) for i in exact]
        hits += [(n, i) for n, layer in ((2, same), (3, venue or bare), (4, fuzzy)) for i in layer if (a[0], i) in agreed]
        out[a[0]] = hits[0][::-1] if hits else (None, None)
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1] / max(len(a), len(b), 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_cascade(spark, seed):
    new, old = entries(seed), entries(seed + 10)
    rng = random.Random(seed)
    agreed = {(a[0], b[0]) for a in new for b in old if rng.random() < 0.2}
    verdicts = [(a, b, True, 0.9) for a, b in agreed] + [(new[0][0], old[0][0], True, 0.7), (new[1][0], old[1][0], False, 1.0)]
    agreed -= {(new[1][0], old[1][0])} if (new[1][0], old[1][0]) not in agreed else set()
    said = spark.createDataFrame(verdicts, "left_id long, right_id long, ok boolean, confidence double")
    got = dedup.cascade(spark.createDataFrame(new, SCHEMA), spark.createDataFrame(old, SCHEMA), said).collect()
    assert {r.id: (r.match_id, r.layer) for r in got} == plain_cascade(new, old, agreed)


def test_reconciler_edges(spark):
    rows = entries(3)
    got = {(r.a_id, r.b_id) for r in dedup.reconciler_edges(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = set()
    for a in rows:
        for b in rows:
            titles = distance(a[1].lower(), b[1].lower()) <= 0.45 and hours(a[2], b[2]) <= 48
            venues = hours(a[2], b[2]) <= 3 and overlap(a, b) or hours(a[2], b[2]) <= 1 and not a[4] and not b[4]
            if a[0] != b[0] and (titles or venues):
                want.add((a[0], b[0]))
    assert got == want


def test_reconciler_pairs_at_the_reconcilers_own_likeness(spark, tmp_path):
    """F2: the query lists the titles that are alike at 0.45, not only nearly equal ones."""
    from calendrix.plans.monitor_queries import reconciler_pairs

    made = "id AS event_id", "element_at(array('view', 'click', 'purchase', 'view'), int(id % 4) + 1) AS event_type", "id * 7 AS user_id"
    events = spark.range(1, 80).selectExpr(*made, "timestamp_ntz '2026-01-05 10:00:00' + make_dt_interval(0, id) AS ts")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in reconciler_pairs(spark, str(tmp_path)).collect()]
    rows = [(r.event_id, f"{r.event_type} {r.user_id % 20}", r.ts.replace(hour=0, minute=0) if r.event_id % 50 < 2 else r.ts) for r in events.collect()]
    wide = {(a[0], b[0]) for a in rows for b in rows if 0.05 < distance(a[1], b[1]) <= 0.45 and hours(a[2], b[2]) <= 48}
    assert len(wide) > 1000
    assert wide <= set(got)
    assert len(got) == len(set(got))


def test_pairs_are_made_by_all_tasks_and_not_shuffled(spark):
    """pairs leave the joins as they are, by as many tasks as the session has."""
    events = spark.createDataFrame(entries(3), SCHEMA)
    pairs = dedup.reconciler_edges(events)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("Join")]
    assert "REPARTITION_BY_NUM" in dedup.fuzzy_pairs(events, events)._jdf.queryExecution().executedPlan().toString()


def test_the_closest_titles_of_a_hot_hour(spark):
    """the first of each by score and arrival are found without the pairs of the hour, whatever the title."""
    made = "concat('Evening ', id % 7) AS title", "timestamp '2026-01-05 10:00:00' + make_dt_interval(0, 0, id % 60) AS start", "id * 7919 % 10007 AS arrival"
    rows = spark.range(700).selectExpr("id", *made).union(spark.sql("SELECT 1000L, 'Evening 9', timestamp '2026-01-05 10:30:00', 5L"))
    got = dedup.fuzzy_pairs(rows, rows, most=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" not in plan
    data = rows.collect()
    want = set()
    for a in data:
        near = sorted((distance(a.title.lower(), b.title.lower()), b.arrival, b.id) for b in data if b.id != a.id)
        want |= {(a.id, b[2], n + 1) for n, b in enumerate(near[:3])}
    assert {(r.a_id, r.b_id, r["rank"]) for r in got.collect()} == want


def test_merge_targets(spark):
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 99), (8, 8), (9, 10), (10, 9)]
    got = {r.id: r.target for r in dedup.merge_targets(spark.createDataFrame(rows, "id long, merged_into_id long")).collect()}
    assert {i: got[i] for i in (2, 3, 4, 5, 6, 7)} == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 99}


@pytest.mark.parametrize("bound", [1000, 0])
def test_greedy_clusters(spark, bound):
    rng = random.Random(5)
    events = [(i, T0 + dt.timedelta(minutes=rng.randrange(50))) for i in range(60)]
    pairs = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70)) if a != b}
    pairs |= {(b, a) for a, b in pairs}
    taken, want = set(), {}
    for i, _ in sorted(events, key=lambda e: (e[1], e[0])):
        if i in taken:
            continue
        star = [b for a, b in pairs if a == i and b not in taken]
        if star:
            taken |= {i, *star}
            want |= {x: i for x in [i, *star]}
    edges = spark.createDataFrame(sorted(pairs), "a_id long, b_id long")
    got = dedup.clusters(spark.createDataFrame(events, "id long, start timestamp"), edges, dedup.components(edges), bound)
    assert {r.id: r["head"] for r in got.collect()} == want


def test_matching_keys(spark):
    schema = "id long, url string, source string, source_event_id string, arrival long"
    old = spark.createDataFrame([(1, "http://a/x/", "s", "1", 1), (2, "http://a/x?y", "s", "2", 2), (3, None, "s", "1", 3), (4, "http://b", None, None, 4)], schema)
    new = spark.createDataFrame([(10, "http://A/x", "s", "9", 0), (11, "http://z", "s", "1", 0), (12, "http://a/x", "s", "2", 0), (13, None, None, "", 0)], schema).drop("arrival")
    got = {r.id: (r.existing_id, r.signal) for r in dedup.match_existing(new, old).collect()}
    assert got == {10: (1, "url"), 11: (3, "source_event_id"), 12: (1, "url+id"), 13: (None, None)}


def test_merges(spark):
    schema = "id long, venue string, address string, deleted_at timestamp, merged_into_id long"
    events = spark.createDataFrame([(1, "", None, None, None), (2, "", "B st", None, None), (3, "Hall", "C st", None, None), (4, "Own", None, None, None)], schema)
    losers = spark.createDataFrame([(2, 1, 1), (3, 1, 2)], "id long, canonical_id long, rank int")
    now = dt.datetime(2026, 1, 1)
    got = {r.id: tuple(r)[1:] for r in dedup.merged(events, losers, ["venue", "address"], F.lit(now)).collect()}
    assert got == {1: ("Hall", "B st", None, None), 2: ("", "B st", now, 1), 3: ("Hall", "C st", now, 1), 4: ("Own", None, None, None)}
    gate = spark.createDataFrame([(True, 0.9, 1), (True, 0.8, 1), (False, 1.0, 1), (True, 0.9, None), (None, None, None)], "is_duplicate boolean, confidence double, canonical_id long")
    assert [r.action for r in dedup.merge_gate(gate).collect()] == ["merge", "low confidence", "not a duplicate", "unknown canonical", "not a duplicate"]


@pytest.mark.parametrize("partitions", [1, 8])
def test_rate_limit(spark, partitions):
    rng = random.Random(9)
    requests = [(i, rng.choice("abcd"), T0 + dt.timedelta(hours=rng.randrange(90))) for i in range(120)]
    want, kept = {}, {}
    for i, who, at in sorted(requests, key=lambda r: (r[1], r[2], r[0])):
        recent = [x for x in kept.get(who, []) if at - x < dt.timedelta(hours=24)]
        want[i] = len(recent) < 3
        kept[who] = recent + [at] * want[i]
    df = spark.createDataFrame(requests, "request_id long, who string, at timestamp").repartition(partitions)
    assert {r.request_id: r.accepted for r in transitions.rate_limited(df, "who").collect()} == want


def test_scrape_counters(spark):
    rng = random.Random(4)
    runs = [(s, n, rng.choice([0, 0, 0, 2]), rng.choice(["success", "fetch_failed", "parse_uncertain"]), 200, rng.random() < 0.3, s == 0) for s in range(5) for n in range(20)]
    want = {}
    for s, _, events, status, _, keywords, _ in runs:
        state = want.setdefault(s, [0, 0, 0, 0])
        state[3] += events
        if events:
            state[:3] = [0, 0, 0]
        else:
            state[0 if status == "fetch_failed" else 1 if status == "parse_uncertain" or keywords else 2] += 1
    df = spark.createDataFrame(runs, "source long, n long, events long, status string, http_status int, keywords boolean, is_config boolean")
    got = {r.source: r for r in transitions.scrape_counters(df, ["n"]).collect()}
    assert {s: [r.fetch_failures, r.parse_failures, r.empty_scrapes, r.events_found] for s, r in got.items()} == want
    assert all(r.escalate == (want[s][1] >= 3) and r.demote == (want[s][2] >= 3 and s != 0) for s, r in got.items())


def test_upserts_and_inserts(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    rows = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "c", 1), (None, "m", 1)], "k long, v string, arrival long")
    got = sorted(map(tuple, transitions.upsert(state, rows, ["k"], "arrival").collect()), key=str)
    assert got == sorted([(1, "a"), (2, "y"), (3, "c"), (None, "n"), (None, "m")], key=str)
    got = sorted(map(tuple, transitions.insert_absent(state, rows, "k", "arrival").collect()), key=str)
    assert got == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n")], key=str)


def test_selection(spark):
    queries = [(i, p, c, t, T0 + dt.timedelta(days=i), True) for i, (p, c, t) in enumerate([(0.9, "a", 1), (0.8, "agent", 2), (0.7, "a", 1), (0.1, "a", 3), (0.2, "a", 1), (0.5, "agent", 0)])]
    df = spark.createDataFrame(queries, "id long, priority double, created_by string, times_run int, created_at timestamp, is_active boolean")
    assert [(r.id, r.branch) for r in selection.explore_exploit(df, 5).collect()] == [(0, 1), (1, 1), (2, 1), (3, 2), (5, 3)]
    assert [r.id for r in selection.explore_exploit(df.where("id <> 5"), 5).collect()] == [0, 1, 2, 3, 4]
    assert [r.id for r in selection.explore_exploit(df, 2).collect()] == [0, 1]
    assert sorted(r.id for r in selection.beyond_cut(df, [F.desc("priority"), "id"], 2).collect()) == [2, 3, 4, 5]
    events = spark.createDataFrame([(["a"], "x", True, "s"), (["b"], "x", None, "s"), (["a", "b"], "y", False, "t")], "audience array<string>, level string, is_free boolean, source string")
    assert selection.faceted(events, ["a"], ["x", "y"]).count() == 2
    assert selection.faceted(events, None, None, free_only=True).count() == 1
    assert selection.faceted(events, [], [], sources=["t"]).count() == 1 and selection.faceted(events, None, None).count() == 3


def test_lookups(spark):
    due = spark.createDataFrame([("a", None), ("b", T0), ("c", T0)], "url string, last_scraped timestamp")
    plan = spark.createDataFrame([("a",)], "url string")
    got = {r.url: r.reason for r in lookups.floor_rule(due, plan, F.lit(T0 + dt.timedelta(days=3))).collect()}
    assert got == {"a": "planned", "b": "last scraped 3 days ago", "c": "last scraped 3 days ago"}
    actions = spark.createDataFrame([("create_query", "x", "ok"), ("create_query", "y", "Failed: z"), ("create_source_query", "w", "ok"), ("boost_query", "w", "ok"), ("create_query", "u", "Skipped: there"), ("create_query", "v", "Skipped: s"), ("flag", "x", "ok")], "action string, text string, result string")
    known = spark.createDataFrame([("x", True), ("w", False), ("u", True)], "query_text string, is_active boolean")
    assert {r.text: r.status for r in lookups.action_status(actions, known).collect()} == {"x": "active", "y": "failed_to_create", "w": "deactivated_or_recycled", "u": "active"}
    sources = spark.createDataFrame([("https://lu.ma/aitx",), ("https://a.org/x",)], "url string")
    sent = spark.createDataFrame([(1, "https://lu.ma/aitx/7"), (2, "https://lu.ma/other"), (3, "https://www.a.org/z")], "id long, url string")
    assert {(r.id, r.source_url) for r in lookups.feedback_sources(sent, sources).collect()} == {(1, "https://lu.ma/aitx"), (3, "https://a.org/x")}


def test_skips_count_events_without_their_pairs(spark):
    """Events below a shared platform's path, and on a host else; many actions and events of one host make no pairs."""
    from calendrix.operators import intake

    at = "2024-01-30"
    urls = ["https://lu.ma/a/1", "https://lu.ma/a", "https://lu.ma/ab", "https://site.example/x/y"]
    events = spark.createDataFrame([(u, "web-search", at) for u in urls for _ in range(300)], "url string, source string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    asked = [(1, "https://lu.ma/a", None), (2, "https://lu.ma/b", None), (3, "https://site.example/q", None), (4, "https://none.example/", None), (5, "https://lu.ma/a/", None)]
    actions = spark.createDataFrame(asked, "pos long, source_url string, reason string")
    sources = spark.createDataFrame([("https://none.example/", "probation")], "url string, tier string")
    out = intake.skip_results(actions, sources, events, F.lit("2024-01-31").cast("timestamp"))
    assert {r.pos: r.result.startswith("Blocked") for r in out.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    met = spark.createDataFrame([(n, "https://site.example/q", None) for n in range(3000)], "pos long, source_url string, reason string")
    assert rows_made(intake.skip_results(met, sources, events, F.lit("2024-01-31").cast("timestamp"))) < 20_000


def rows_made(df):
    """The most rows that a join of the plan puts out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    most, todo = 0, [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_submissions_are_found_without_pairs_of_common_pieces(spark):
    import random

    from calendrix.operators import monitoring

    rng = random.Random(4)
    events = [(i, f"https://www.Example.com/en/{rng.randrange(900)}", rng.choice(["", f"Page {rng.randrange(400)} About", None])) for i in range(300)]
    asked = [(i, rng.choice([None, "x", "https://www.example.com/en/" + str(rng.randrange(900)), "https://nowhere.example/1"]), rng.choice([None, "", "PAGE " + str(rng.randrange(400)), "no such title", "p"])) for i in range(300)]
    got = monitoring.found_events(spark.createDataFrame(asked, "id long, url string, title string"), spark.createDataFrame(events, "id long, url string, title string"))
    plain = lambda u: u and u.lower().replace("https://", "").replace("www.", "")
    hit = lambda text, body: bool(text) and bool(body) and text in body.lower()
    want = {i: min([e for e, eu, et in events if hit(plain(u), eu) or hit((t or "").lower()[:30], et)], default=None) for i, u, t in asked}
    assert {r.id: r.found_id for r in got.collect()} == want
    assert len(set(want.values())) > 20
    assert rows_made(got) < 12_000


@pytest.mark.parametrize(("name", "column", "values"), [("severity_sort", "severity", {0: 100}), ("plan_completion", "status", {"completed": 15, "pending": 0})])
def test_whole_tables_are_asked(spark, tmp_path, name, column, values):
    """Every order and every customer counts, whatever its key."""
    import __spark_entry__ as driver

    orders = spark.range(1, 151).selectExpr("id AS o_orderkey", "id % 15 + 1 AS o_custkey", "'F' AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice", "TIMESTAMP '2001-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(1, 16).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    got = [r[column] for r in driver.queries()[name](spark, str(tmp_path)).collect()]
    assert {v: got.count(v) for v in values} == values
