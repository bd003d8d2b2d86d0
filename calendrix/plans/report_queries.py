"""Report queries over the test tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.operators import metrics as m
from calendrix.operators import reports as r
from calendrix.operators import selection as sel
from calendrix.plans.base import events_now, orders_now, registry, table
from calendrix.plans.intake_queries import pick, picked
from calendrix.plans.metric_queries import DECISIONS_SQL, decisions

QUERIES, ORACLES, query = registry()

NOW = "TIMESTAMP '2001-08-02'"
NAMES = ["discovered", "validated", "added", "duplicates", "errors", "calls", "seconds", "searches"]
PRIMES = [40, 37, 11, 23, 3, 50, 400, 5]


def runs(spark, sf_dir):
    n = F.col("o_orderkey") * 7 + F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"), *[F.when(n % 19 != 0, n % p).alias(c) for c, p in zip(NAMES, PRIMES)])


RUNS = "WITH runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started, " + ", ".join(f"CASE WHEN n % 19 <> 0 THEN n % {p} END AS {c}" for c, p in zip(NAMES, PRIMES)) + " FROM (SELECT *, o_orderkey * 7 + o_custkey AS n FROM orders)) "


@query("SELECT count(DISTINCT source) AS contributing FROM documents")
def contributing_sources(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count_distinct("source").alias("contributing"))


def _avg(c: str, digits: bool) -> str:
    return f"floor(avg(coalesce({c}, 0)) * 10 + 0.5) / 10 AS avg_{c}" if digits else f"CAST(floor(avg(coalesce({c}, 0)) + 0.5) AS BIGINT) AS avg_{c}"


@query(RUNS + f""", top AS (SELECT * FROM runs ORDER BY started DESC, run_id DESC LIMIT 30) SELECT count(*) AS runs, {', '.join(_avg(c, False) for c in ('discovered', 'validated', 'duplicates', 'calls', 'seconds'))}, {_avg('added', True)}, {_avg('errors', True)},
CAST(coalesce(sum(added), 0) AS BIGINT) AS total_added, CAST(coalesce(sum(errors), 0) AS BIGINT) AS total_errors FROM top WHERE started >= {NOW} - INTERVAL 7 DAY""")
def run_averages(spark, sf_dir):
    return r.run_averages(runs(spark, sf_dir), "started", orders_now())


def _window(days: int) -> str:
    inside = f"FILTER (WHERE started > {NOW} - INTERVAL {days} DAY)"
    calls, added = f"coalesce(sum(calls) {inside}, 0)", f"coalesce(sum(added) {inside}, 0)"
    sums = ", ".join(f"CAST(coalesce(sum({c}) {inside}, 0) AS BIGINT) AS {c}_{days}" for c in ("calls", "searches", "added"))
    return f"{sums}, round({calls} * 0.015::DOUBLE, 4) AS cost_{days}, round(coalesce({calls} * 0.015::DOUBLE / nullif({added}, 0), 0), 4) AS cost_per_event_{days}"


@query(RUNS + f"SELECT {_window(7)}, {_window(30)}, round(coalesce(sum(calls) FILTER (WHERE started > {NOW} - INTERVAL 30 DAY), 0) * 0.015::DOUBLE / 30, 4) AS daily_cost, round(coalesce((SELECT calls FROM runs ORDER BY started DESC, run_id DESC LIMIT 1), 0) * 0.015::DOUBLE, 4) AS last_run_cost FROM runs")
def cost_panel(spark, sf_dir):
    return r.cost_panel(runs(spark, sf_dir), "started", orders_now())


STATUSES, CODES = ["success", "fetch_failed", "parse_uncertain", "success"], [200, 200, 403, None]


def performance(spark, sf_dir):
    """Events of each supplier, and a last scrape for those of even number."""
    items = table(spark, sf_dir, "lineitem")
    sums = items.groupBy(F.col("l_suppkey").alias("source")).agg(F.sum(F.when(F.col("l_suppkey") % 5 == 0, 0).otherwise(F.col("l_linenumber"))).alias("events"))
    n = F.col("source")
    last = sums.where("source % 2 = 0").select("source", pick(STATUSES, F.floor(n / 2)).alias("status"), pick(CODES, F.floor(n / 8), "int").alias("http_status"), pick(["luma", "scrape"], F.floor(n / 2)).alias("scraper"))
    return sums, last


PERFORMANCE = f"""WITH p AS (SELECT l_suppkey AS source, CAST(sum(CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE l_linenumber END) AS BIGINT) AS events FROM lineitem GROUP BY 1),
l AS (SELECT source, {picked(STATUSES, 'source // 2')} AS status, CAST({picked(CODES, 'source // 8')} AS INTEGER) AS http_status, {picked(['luma', 'scrape'], 'source // 2')} AS scraper FROM p WHERE source % 2 = 0) """


@query(PERFORMANCE + """SELECT count(*) FILTER (WHERE good) AS healthy, count(*) AS total, CAST(floor(count(*) FILTER (WHERE good) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS rate
FROM (SELECT events > 0 AND NOT coalesce(status IN ('fetch_failed', 'parse_uncertain') OR coalesce(http_status IN (403, 429), false), false) AS good FROM p LEFT JOIN l USING (source) WHERE source IN (1, 2, 3, 4, 5, 6, 8, 10, 16, 18, 24, 26))""")
def scraper_health(spark, sf_dir):
    sums, last = performance(spark, sf_dir)
    return r.scraper_health(sums, last, [1, 2, 3, 4, 5, 6, 8, 10, 16, 18, 24, 26])


@query(PERFORMANCE + "SELECT source, events, scraper, status AS last_status, http_status AS last_http_status FROM p LEFT JOIN l USING (source)")
def performance_enriched(spark, sf_dir):
    return r.enriched_performance(*performance(spark, sf_dir))


@query("""WITH s AS (SELECT 'q' || o_orderkey AS q FROM orders WHERE o_totalprice / 500000 < 0.2 AND o_custkey % 6 >= 3) SELECT (SELECT count(*) FROM s) AS stale, (SELECT string_agg(q, ',' ORDER BY q) FROM (SELECT q FROM s ORDER BY q LIMIT 5)) AS names""")
def stale_query_summary(spark, sf_dir):
    queries = table(spark, sf_dir, "orders").select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("query_text"), (F.col("o_totalprice") / 500000).alias("priority"), (F.col("o_custkey") % 6).alias("times_run"))
    return r.stale_summary(queries).select("stale", F.array_join("names", ",").alias("names"))


OUTCOMES = ["accepted", "rejected", "skipped", "duplicated", "updated", "error"]
PIVOT = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in OUTCOMES)


@query(DECISIONS_SQL + f""", n AS (SELECT source, reason, count(*) AS n FROM decisions WHERE outcome IN ('rejected', 'skipped') GROUP BY 1, 2)
SELECT source, {PIVOT}, (SELECT string_agg(n.reason || '=' || n.n, ',' ORDER BY n.reason) FROM n WHERE n.source = d.source) AS reasons FROM decisions d GROUP BY source""")
def decisions_by_source(spark, sf_dir):
    made = r.decisions_by_source(decisions(spark, sf_dir), OUTCOMES)
    reasons = F.array_join(F.transform(F.array_sort(F.map_entries("reasons")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return made.withColumn("reasons", reasons)


@query(DECISIONS_SQL + f"""SELECT source, CAST(coalesce(floor(accepted * 100.0::DOUBLE / nullif(total, 0) + 0.5), 0) AS INTEGER) AS accept_percent, CAST(coalesce(floor(duplicated * 100.0::DOUBLE / nullif(total, 0) + 0.5), 0) AS INTEGER) AS duplicate_percent,
CAST(coalesce(floor((rejected + skipped) * 100.0::DOUBLE / nullif(total, 0) + 0.5), 0) AS INTEGER) AS reject_percent FROM (SELECT *, accepted + rejected + duplicated + updated + skipped + error AS total FROM (SELECT source, {PIVOT} FROM decisions GROUP BY 1))""")
def outcome_shares(spark, sf_dir):
    return r.outcome_shares(m.outcome_pivot(decisions(spark, sf_dir), OUTCOMES))


@query(DECISIONS_SQL + f"""SELECT source, accepted + rejected + duplicated + skipped AS activity FROM (SELECT source, {PIVOT} FROM decisions GROUP BY 1) ORDER BY activity DESC, source LIMIT 20""")
def busiest_sources(spark, sf_dir):
    return sel.by_activity(m.outcome_pivot(decisions(spark, sf_dir), OUTCOMES), 20).select("source", "activity")


@query(DECISIONS_SQL + """SELECT stage, n, floor(n * 100.0::DOUBLE / max(n) OVER () * 10 + 0.5) / 10 AS width FROM (SELECT stage, count(*) AS n FROM decisions GROUP BY 1)""")
def stage_bars(spark, sf_dir):
    return r.stage_bars(m.counts_by(decisions(spark, sf_dir), "stage"))


@query("SELECT conv_id AS id, role, CAST(count(*) AS INTEGER) AS n FROM conversations GROUP BY 1, 2")
def findings_within(spark, sf_dir):
    """Findings of a report, an array, counted by a field of theirs."""
    reports = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("role", "turn")).alias("findings"))
    return r.findings_by(reports, "role")


@query("""SELECT count(*) AS evaluated, floor(count(*) FILTER (WHERE event_id % 3 = 0) * 1.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS hit_rate, floor(avg(CASE WHEN event_id % 3 = 0 THEN 0.1::DOUBLE ELSE -0.05::DOUBLE END) * 1000 + 0.5) / 1000 AS avg_delta FROM events WHERE ts >= TIMESTAMP '2024-01-17'""")
def confidence_window(spark, sf_dir):
    hit = F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
    made = table(spark, sf_dir, "events").select("ts", hit.alias("hit"), F.when(F.col("event_id") % 3 == 0, 0.1).otherwise(-0.05).alias("delta"))
    return m.confidence_summary(made, "ts", events_now())


@query("""SELECT count(*) AS observed, count(*) FILTER (WHERE event_type = 'error' OR n = 0 OR n >= 10) AS triggers, CAST(10 AS BIGINT) AS adjustments, count(*) FILTER (WHERE n > e * 1.5::DOUBLE OR n < e * 0.5::DOUBLE) AS deviations, count(*) FILTER (WHERE event_type = 'error') AS errors
FROM (SELECT *, CAST(floor(value / 10) AS BIGINT) AS n, user_id % 12 AS e FROM events WHERE event_id % 4 <> 0)""")
def deviation_summary(spark, sf_dir):
    results = table(spark, sf_dir, "events").select(F.col("user_id").alias("url"), (F.col("event_id") % 4 != 0).alias("planned"), F.floor(F.col("value") / 10).alias("events"), (F.col("event_type") == "error").alias("error"), (F.col("user_id") % 12).alias("expected"))
    return r.deviations(results)


GRADED = """WITH g AS (SELECT o_custkey AS k, o_orderdate AS made, o_orderkey AS id, CASE WHEN o_totalprice > 60000 THEN 'A' ELSE 'B' END AS grade, substring(CASE WHEN o_orderkey % 9 = 0 THEN 'other' ELSE repeat('same ', 25) || o_orderkey END, 1, 100) AS head FROM orders),
 n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY made DESC, id) AS rn, first(grade) OVER (PARTITION BY k ORDER BY made DESC, id) AS g0, first(head) OVER (PARTITION BY k ORDER BY made DESC, id) AS h0 FROM g),
 s AS (SELECT k, g0 AS grade, coalesce(min(rn) FILTER (WHERE grade <> g0), count(*) + 1) - 1 AS streak, coalesce(min(rn) FILTER (WHERE head <> h0), count(*) + 1) - 1 AS alike FROM n GROUP BY 1, 2) """


@query(GRADED + "SELECT k, grade, streak, alike, streak >= 5 AND alike >= 5 AS stale FROM s")
def report_staleness(spark, sf_dir):
    """Grades and beginnings of summaries that no longer change."""
    said = F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise(F.concat(F.repeat(F.lit("same "), 25), F.col("o_orderkey").cast("string")))
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.when(F.col("o_totalprice") > 60000, "A").otherwise("B").alias("grade"), said.alias("summary"))
    return r.stale_reports(reports, "k", "at", "id")


@query("SELECT count(*) AS findings, count(*) FILTER (WHERE p_partkey % 5 <> 0) AS probed, count(*) FILTER (WHERE p_partkey % 5 <> 0 AND p_size % 4 > 0) AS viable, count(*) FILTER (WHERE p_partkey % 5 <> 0 AND p_size % 4 = 0) AS empty FROM part")
def scout_summary(spark, sf_dir):
    return r.scout_summary(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") % 4).alias("events")))


@query("SELECT count(*) FILTER (WHERE o_orderstatus <> 'F') AS unresolved, count(*) FILTER (WHERE o_orderstatus = 'F') AS resolved, count(*) FILTER (WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT') AS critical FROM orders")
def item_stats(spark, sf_dir):
    return r.item_stats(table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").alias("is_resolved"), F.when(F.col("o_orderpriority") == "1-URGENT", "critical").otherwise("info").alias("severity")))


@query("""SELECT l_orderkey AS source, CAST(first(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 200 + l_linenumber END ORDER BY l_linenumber, l_partkey) AS INTEGER) AS http_status, CAST(sum(l_quantity) AS BIGINT) AS page_size, string_agg('a' || l_linenumber || ',b', ',' ORDER BY l_linenumber, l_partkey) AS attempts,
CAST(coalesce(first(l_linenumber ORDER BY l_linenumber, l_partkey) FILTER (WHERE l_suppkey % 3 = 0), last(l_linenumber ORDER BY l_linenumber, l_partkey)) AS INTEGER) AS strategy FROM (SELECT DISTINCT l_orderkey, l_linenumber, 0 AS l_partkey, l_quantity, l_suppkey FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL HAVING count(*) = 1)) GROUP BY 1""".replace("SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY ALL", "SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber"))
def merged_diagnostics(spark, sf_dir):
    """Diagnostics of a source that is scraped in parts; lines that are in an order twice are left out."""
    items = table(spark, sf_dir, "lineitem")
    once = items.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("times")).where("times = 1").drop("times")
    n = F.col("l_linenumber")
    parts = items.join(once, ["l_orderkey", "l_linenumber"]).select(
        F.col("l_orderkey").alias("source"), n.cast("int").alias("place"), F.when(n % 3 != 0, 200 + n).cast("int").alias("http_status"), F.col("l_quantity").cast("bigint").alias("page_size"),
        F.array(F.concat(F.lit("a"), n.cast("string")), F.lit("b")).alias("attempts"), (F.col("l_suppkey") % 3 == 0).cast("int").alias("events"),
    )
    return r.merged_diagnostics(parts).withColumn("attempts", F.array_join("attempts", ","))


def _top(kind: str, where: str, most: int | None) -> str:
    return f"(SELECT '{kind}' AS kind, o_orderkey AS id FROM orders WHERE {where} AND o_orderdate >= {NOW} - INTERVAL 30 DAY ORDER BY o_orderdate DESC, o_orderkey {f'LIMIT {most}' if most else ''})"


@query(" UNION ALL ".join(_top(*x) for x in (("experiments", "o_orderstatus = 'F'", None), ("reports", "o_orderpriority = '1-URGENT'", 15), ("plans", "o_orderstatus = 'P'", 15), ("runs", "true", 30), ("audits", "o_orderpriority = '5-LOW'", 10))))
def reflection_reads(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), "o_orderpriority", F.when(F.col("o_orderstatus") == "F", "evaluated").when(F.col("o_orderstatus") == "P", "completed").alias("status"))
    reads = r.reflection_window(orders, orders.where("o_orderpriority = '1-URGENT'"), orders, orders, orders.where("o_orderpriority = '5-LOW'"), orders_now())
    out = None
    for name, df in reads.items():
        part = df.select(F.lit(name).alias("kind"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24' ORDER BY ts DESC, event_id")
def recently_added(spark, sf_dir):
    return r.recent(table(spark, sf_dir, "events"), "ts", events_now(), 7, "event_id").select("event_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-17' AND event_type <> 'error' ORDER BY ts, event_id")
def reconciler_window(spark, sf_dir):
    """Live events of the coming week, in order of start."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start_time"), F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))
    return sel.starting(rows, F.lit("2024-01-10").cast("timestamp"), 7).orderBy("start_time", "event_id").select("event_id", F.col("start_time").alias("ts"))


@query("""SELECT 'last' AS kind, o_orderkey AS id FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1) UNION ALL SELECT 'page', o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5 OFFSET 1)
UNION ALL SELECT 'first with', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 490000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 1)""")
def latest_rows(spark, sf_dir):
    """The last run, the page of those before it, and the last one that passes a test."""
    orders = table(spark, sf_dir, "orders")
    kinds = (("last", r.latest(orders, "o_orderdate", "o_orderkey")), ("page", r.latest(orders, "o_orderdate", "o_orderkey", 1, 5)), ("first with", r.latest_with(orders, "o_orderdate", "o_orderkey", F.col("o_totalprice") > 490000)))
    out = None
    for name, df in kinds:
        part = df.select(F.lit(name).alias("kind"), F.col("o_orderkey").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_of_each(spark, sf_dir):
    return r.latest_of_each(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT * FROM (SELECT 'performer' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 5 > 0 ORDER BY o_custkey % 5 DESC, o_orderkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'queue', o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)""")
def query_lists(spark, sf_dir):
    """The agent's queries that found most, and the newest that never ran."""
    own = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("found"), (F.col("o_custkey") % 7).alias("times_run"), "o_orderdate")
    best = own.where("found > 0").orderBy(F.desc("found"), "id").limit(5).select(F.lit("performer").alias("kind"), "id")
    return best.union(r.latest(own.where("times_run = 0"), "o_orderdate", "id", 0, 5).select(F.lit("queue").alias("kind"), "id"))


@query(f"""SELECT * FROM (SELECT 'promoted' AS kind, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= {NOW} - INTERVAL 7 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 3) UNION ALL SELECT * FROM (SELECT 'demoted', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= {NOW} - INTERVAL 7 DAY ORDER BY o_orderdate DESC, o_orderkey LIMIT 3)""")
def tier_moves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    take = lambda kind, status: r.recent(orders.where(F.col("o_orderstatus") == status), "o_orderdate", orders_now(), 7, "o_orderkey", 3).select(F.lit(kind).alias("kind"), F.col("o_orderkey").alias("id"))
    return take("promoted", "F").union(take("demoted", "O"))


@query("""SELECT o_orderkey, CASE WHEN h >= 80 AND e < 5 AND c >= 4 AND a > 0 THEN 'A' WHEN h >= 60 AND e < 10 AND c >= 3 THEN 'B' WHEN h >= 40 THEN 'C' ELSE 'D' END AS grade FROM (SELECT o_orderkey, o_orderkey % 101 AS h, o_custkey % 12 AS e, o_custkey % 6 AS c, o_orderkey % 3 AS a FROM orders)""")
def report_grades(spark, sf_dir):
    grade = m.grade_letter(F.col("o_orderkey") % 101, F.col("o_custkey") % 12, F.col("o_custkey") % 6, F.col("o_orderkey") % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", grade.alias("grade"))


@query("""SELECT o_orderkey AS run_id, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'e0' ELSE 'e0,e1,e2' END AS errors FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def compact_runs(spark, sf_dir):
    n = F.col("o_orderkey") % 3
    errors = F.when(n == 0, F.array().cast("array<string>")).when(n == 1, F.array(F.lit("e0"))).otherwise(F.array(*[F.lit(f"e{i}") for i in range(5)]))
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderdate", errors.alias("error_messages"))
    return r.compact_runs(made, "o_orderdate", "run_id").select("run_id", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.array_join("error_messages", ",").alias("errors"))
