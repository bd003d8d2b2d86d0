"""Metric queries over the test tables, each with its DuckDB twin.

Roles: events are decisions and page views (event_type: outcome, user_id: source), orders are runs
(o_orderdate: start, status F: an error), labels are validation outcomes, pages are scrapes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from calendrix.operators import metrics as m
from calendrix.plans.base import events_now, orders_now, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def decisions(spark, sf_dir):
    outcome = F.create_map(*[F.lit(x) for p in (("purchase", "accepted"), ("error", "rejected"), ("view", "skipped"), ("click", "duplicated"), ("signup", "updated")) for x in p])
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("source"), outcome[F.col("event_type")].alias("outcome"),
        F.concat(F.lit("reason "), (F.col("event_id") % 13).cast("string")).alias("reason"), (F.col("event_id") % 4).alias("stage"), (F.col("event_id") % 3 == 0).alias("called"),
    )


DECISIONS_SQL = """WITH decisions AS (SELECT event_id, ts, user_id AS source,
  CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'skipped' WHEN 'click' THEN 'duplicated' WHEN 'signup' THEN 'updated' END AS outcome,
  'reason ' || (event_id % 13) AS reason, event_id % 4 AS stage, event_id % 3 = 0 AS called FROM events) """


def runs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started"), (F.col("o_custkey") % 50).alias("calls"), (F.col("o_orderkey") % 11).alias("added"),
        (F.col("o_custkey") % 40).alias("discovered"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("errors"),
    )


RUNS_SQL = """WITH runs AS (SELECT o_orderkey AS run_id, o_orderdate AS started, o_custkey % 50 AS calls, o_orderkey % 11 AS added,
  o_custkey % 40 AS discovered, CAST(o_orderstatus = 'F' AS BIGINT) AS errors FROM orders) """


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return m.counts_by(table(spark, sf_dir, "documents"), "source")


@query("SELECT coalesce(nullif(c_mktsegment, ''), 'probation') AS tier, count(*) AS n FROM customer GROUP BY 1")
def tier_counts(spark, sf_dir):
    return m.tier_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1")
def weekly_counts(spark, sf_dir):
    return m.weekly_counts(table(spark, sf_dir, "orders"), "o_orderdate")


@query(RUNS_SQL + "SELECT CAST(started AS DATE) AS day, CAST(sum(added) AS BIGINT) AS added FROM runs WHERE started >= TIMESTAMP '2001-07-03' GROUP BY 1")
def daily_added(spark, sf_dir):
    recent = runs(spark, sf_dir).where(F.col("started") >= orders_now() - F.make_dt_interval(F.lit(30)))
    return m.daily_sum(recent, "started", F.col("added"))


@query(RUNS_SQL + """, daily AS (SELECT CAST(started AS DATE) AS day, sum(added) AS added FROM runs GROUP BY 1)
SELECT CAST(sum(added) AS BIGINT) AS total, floor(sum(added) / count(*) * 10 + 0.5) / 10 AS per_day FROM daily""")
def chart_totals(spark, sf_dir):
    return m.chart_totals(m.daily_sum(runs(spark, sf_dir), "started", F.col("added")))


@query(RUNS_SQL + """SELECT count(*) AS runs, count(*) FILTER (WHERE errors = 0) AS successes,
floor(count(*) FILTER (WHERE errors = 0) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS success_percent,
CAST(sum(added) AS BIGINT) AS added, floor(avg(added) * 10 + 0.5) / 10 AS avg_added FROM runs""")
def run_totals(spark, sf_dir):
    return m.run_totals(runs(spark, sf_dir))


def _cost_sql(days: int) -> str:
    inside = f"FILTER (WHERE started >= TIMESTAMP '2001-08-02' - INTERVAL {days} DAY)"
    calls, added = f"coalesce(sum(calls) {inside}, 0)", f"coalesce(sum(added) {inside}, 0)"
    return (
        f"CAST({calls} AS BIGINT) AS calls_{days}, CAST({added} AS BIGINT) AS added_{days}, round({calls} * 0.015::DOUBLE, 4) AS cost_{days}, "
        f"round(coalesce({calls} * 0.015::DOUBLE / nullif({added}, 0), 0), 4) AS cost_per_event_{days}"
    )


@query(RUNS_SQL + f"SELECT {_cost_sql(7)}, {_cost_sql(30)} FROM runs")
def cost_windows(spark, sf_dir):
    return m.cost_windows(runs(spark, sf_dir), "started", orders_now())


@query(RUNS_SQL + """, top AS (SELECT * FROM runs ORDER BY started DESC, run_id DESC LIMIT 30)
SELECT count(*) AS runs, CAST(floor(avg(discovered) + 0.5) AS BIGINT) AS avg_discovered, floor(avg(added) * 10 + 0.5) / 10 AS avg_added,
floor(avg(errors) * 10 + 0.5) / 10 AS avg_errors, CAST(sum(added) AS BIGINT) AS sum_added FROM top WHERE started >= TIMESTAMP '2001-07-26'""")
def seven_day_averages(spark, sf_dir):
    return m.window_averages(runs(spark, sf_dir), "started", orders_now())


@query(DECISIONS_SQL + """SELECT source, count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'duplicated') AS duplicated,
count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) AS decisions FROM decisions GROUP BY 1""")
def outcome_pivot(spark, sf_dir):
    return m.outcome_pivot(decisions(spark, sf_dir), ["accepted", "rejected", "skipped", "duplicated", "updated"])


@query(DECISIONS_SQL + "SELECT stage, count(*) AS n FROM decisions GROUP BY 1")
def stage_counts(spark, sf_dir):
    return m.counts_by(decisions(spark, sf_dir), "stage")


@query(DECISIONS_SQL + """SELECT reason, count(*) AS n, count(DISTINCT source) AS sources FROM decisions
WHERE outcome IN ('rejected', 'skipped') AND reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 10""")
def top_rejection_reasons(spark, sf_dir):
    return m.top_reasons(decisions(spark, sf_dir), ["rejected", "skipped"])


@query(DECISIONS_SQL + "SELECT stage, source, count(*) AS n FROM decisions WHERE outcome = 'duplicated' GROUP BY 1, 2 ORDER BY n DESC, stage, source LIMIT 10")
def top_duplicate_sources(spark, sf_dir):
    return m.top_duplicate_sources(decisions(spark, sf_dir), "duplicated")


@query(DECISIONS_SQL + """SELECT source, count(*) FILTER (WHERE called) AS calls, count(*) FILTER (WHERE outcome = 'accepted') AS accepted,
floor(count(*) FILTER (WHERE called) * 0.001::DOUBLE / nullif(count(*) FILTER (WHERE outcome = 'accepted'), 0) * 10000 + 0.5) / 10000 AS cost_per_event FROM decisions GROUP BY 1""")
def cost_efficiency(spark, sf_dir):
    return m.cost_efficiency(decisions(spark, sf_dir))


@query(DECISIONS_SQL + """SELECT count(*) FILTER (WHERE outcome = 'accepted') AS accepted, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
count(*) FILTER (WHERE outcome = 'duplicated') AS duplicated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
CAST(floor(count(*) FILTER (WHERE outcome = 'accepted') * 100.0::DOUBLE / count(*) FILTER (WHERE outcome <> 'updated') + 0.5) AS INTEGER) AS accept_percent FROM decisions""")
def decision_totals(spark, sf_dir):
    return m.decision_totals(decisions(spark, sf_dir))


def outcomes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", (F.col("quality") == 1).alias("passed"))


TALLY_SQL = """WITH tally AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality <> 1) AS failed
  FROM labels JOIN documents USING (doc_id) GROUP BY 1) """


@query(TALLY_SQL + "SELECT source, passed, failed, CAST(floor(passed * 100.0::DOUBLE / (passed + failed) + 0.5) AS INTEGER) AS pass_rate FROM tally")
def pass_rates(spark, sf_dir):
    return m.validation_tally(outcomes(spark, sf_dir))


@query(TALLY_SQL + """SELECT source, passed, failed, CAST(floor(passed * 100.0::DOUBLE / (passed + failed) + 0.5) AS INTEGER) AS pass_rate FROM tally
WHERE passed % 4 >= 2 OR (failed > passed AND failed >= 3)""")
def source_issues(spark, sf_dir):
    return m.with_issues(m.validation_tally(outcomes(spark, sf_dir)), F.col("passed") % 4)


@query(TALLY_SQL + """SELECT source, passed, failed, CAST(floor(passed * 100.0::DOUBLE / (passed + failed) + 0.5) AS INTEGER) AS pass_rate FROM tally
WHERE (passed + failed >= 5 AND passed * 1.0::DOUBLE / (passed + failed) < 0.5) OR passed % 5 >= 3 ORDER BY passed * 1.0::DOUBLE / (passed + failed), source LIMIT 3""")
def struggling_sources(spark, sf_dir):
    return m.struggling(m.validation_tally(outcomes(spark, sf_dir)), F.col("passed") % 5)


@query("""SELECT CAST(d AS DATE) AS day FROM range(DATE '2001-06-01', DATE '2001-06-01' + 90, INTERVAL 1 DAY) t(d)
WHERE CAST(d AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""")
def calendar_gaps(spark, sf_dir):
    return m.calendar_gaps(table(spark, sf_dir, "orders"), "o_orderdate", dt.date(2001, 6, 1), 90)


@query("SELECT event_type, count(*) AS visitors FROM (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, user_id FROM events) GROUP BY 1")
def unique_visitors(spark, sf_dir):
    return m.unique_visitors(table(spark, sf_dir, "events"), "event_type", "user_id", "ts")


AGENTS = ["Mozilla/5.0 GPTBot/1.0", "Mozilla/5.0 (Windows)", "bingbot/2.0", "claudebot", "Nokia3310", "curl/8"]
_AGENTS_SQL = "['" + "', '".join(AGENTS) + "'][CAST(event_id % 6 AS INTEGER) + 1]"


def views(spark, sf_dir):
    agent = F.get(F.array(*map(F.lit, AGENTS)), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("page"), "ts", agent.alias("agent"))


@query(f"""SELECT event_type AS page, count(*) AS crawlers FROM events WHERE regexp_matches({_AGENTS_SQL},
'GPTBot|ChatGPT|ClaudeBot|Claude-Web|Anthropic|Google-Extended|CCBot|PerplexityBot|Bytespider|Amazonbot|cohere-ai|Manus-User', 'i') GROUP BY 1""")
def ai_crawlers(spark, sf_dir):
    from calendrix.functions.text import ai_crawler

    return m.counts_by(views(spark, sf_dir).where(ai_crawler(F.col("agent"))), "page", name="crawlers")


@query(f"""SELECT event_type AS page, CASE WHEN regexp_matches({_AGENTS_SQL}, 'GPTBot|Nokia[0-9]|bot|crawl|spider', 'i') THEN 'bot' ELSE 'human' END AS visitor, count(*) AS n FROM events GROUP BY 1, 2""")
def visitor_types(spark, sf_dir):
    from calendrix.functions.text import visitor_type

    return m.counts_by(views(spark, sf_dir).withColumn("visitor", visitor_type(F.col("agent"))), "page", "visitor")


@query("""SELECT l_suppkey AS source, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_linenumber END) AS BIGINT) AS events, count(*) AS runs,
count(*) FILTER (WHERE l_returnflag = 'N') AS zero_runs FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 14) GROUP BY 1""")
def source_performance(spark, sf_dir):
    found = F.when(F.col("l_returnflag") == "N", 0).otherwise(F.col("l_linenumber")).cast("bigint")
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("source"), found.alias("events"))
    return m.source_performance(results, table(spark, sf_dir, "orders"), "o_orderkey", "o_orderdate")


@query("SELECT event_type AS kind, count(DISTINCT user_id) AS sources FROM events WHERE value < 1 GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def failure_groups(spark, sf_dir):
    empty = table(spark, sf_dir, "events").where("value < 1").withColumnRenamed("user_id", "source")
    return m.failure_groups(empty, "event_type")


@query("SELECT count(*) FILTER (WHERE value > 10) AS healthy, count(*) AS total, CAST(floor(count(*) FILTER (WHERE value > 10) * 100.0::DOUBLE / count(*) + 0.5) AS INTEGER) AS rate FROM events")
def health_rate(spark, sf_dir):
    return m.health_rate(table(spark, sf_dir, "events"), F.col("value") > 10)


@query("""SELECT count(*) AS evaluated, floor(count(*) FILTER (WHERE quality = 1) * 1.0::DOUBLE / count(*) * 100 + 0.5) / 100 AS hit_rate,
floor(avg(CASE WHEN quality = 1 THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END) * 1000 + 0.5) / 1000 AS avg_delta FROM labels""")
def confidence_summary(spark, sf_dir):
    hit = F.col("quality") == 1
    return m.hit_summary(table(spark, sf_dir, "labels").select(hit.alias("hit"), F.when(hit, 0.1).otherwise(-0.1).alias("delta")))


@query(RUNS_SQL + """SELECT round(coalesce(sum(CASE WHEN calls > 0 THEN 0.1::DOUBLE + floor(calls * 0.05::DOUBLE + 0.5) * 0.015::DOUBLE
+ greatest(calls - 1 - floor(calls * 0.05::DOUBLE + 0.5), 0) * 0.001::DOUBLE ELSE 0 END), 0), 4) AS spent FROM runs WHERE CAST(started AS DATE) = DATE '2001-07-30'""")
def spend_today(spark, sf_dir):
    return m.spend_on(runs(spark, sf_dir), "started", F.lit("2001-07-30").cast("date"))


@query("""SELECT *, spent <= 0.05 AS affordable, greatest(0.0::DOUBLE, round(0.05::DOUBLE - spent, 6)) AS remaining FROM (
SELECT user_id, event_id, round(sum(0.001::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events)""")
def budget_running_cap(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.lit(0.001).alias("cost"))
    return m.budget_cap(calls, "user_id", ["ts", "event_id"], "cost", 0.05).drop("ts", "cost")


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER w AS rn, first_value(event_type) OVER w AS latest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, latest AS grade, coalesce(min(rn) FILTER (WHERE event_type <> latest), count(*) + 1) - 1 AS streak,
coalesce(min(rn) FILTER (WHERE event_type <> latest), count(*) + 1) - 1 >= 5 AS stale FROM r GROUP BY 1, 2""")
def grade_streak(spark, sf_dir):
    return m.grade_streak(table(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], "event_type")


@query("""SELECT CAST(floor(date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 3600000000.0) AS BIGINT) AS hours, count(*) FILTER (WHERE event_type = 'error') AS fixable,
date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 3600000000.0 > 48 AND count(*) FILTER (WHERE event_type = 'error') >= 1 AS alarm
FROM (SELECT ts, event_type, unnest(['now', 'early', 'quiet']) AS part FROM events) WHERE part = 'now' OR ts < TIMESTAMP '2024-01-20' AND (part = 'early' OR event_type <> 'error') GROUP BY part""")
def repair_heartbeat(spark, sf_dir):
    """Of all runs, of the early ones, and of those early ones that need no repair."""
    runs = table(spark, sf_dir, "events")
    early = runs.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp"))
    beats = [m.heartbeat(part, "ts", events_now(), F.col("event_type") == "error") for part in (runs, early, early.where("event_type != 'error'"))]
    return beats[0].union(beats[1]).union(beats[2])


@query("""WITH f AS (SELECT CASE WHEN doc_id % 50 = 7 THEN 'only-' || doc_id ELSE source END AS slug, lang, doc_id FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS rn FROM f)
SELECT slug, count(*) AS events, min(lang) FILTER (WHERE rn = 1) AS name, CAST(min(doc_id) FILTER (WHERE rn = 3) AS BIGINT) AS third,
CASE WHEN count(*) >= 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS confidence, round(CASE WHEN count(*) >= 2 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * count(*), 4) AS value FROM r GROUP BY 1""")
def organizer_rollup(spark, sf_dir):
    alone = F.concat(F.lit("only-"), F.col("doc_id").cast("string"))
    slug = F.when(F.col("doc_id") % 50 == 7, alone).otherwise(F.col("source"))
    found = table(spark, sf_dir, "documents").select(slug.alias("slug"), F.col("lang").alias("name"), F.col("doc_id").alias("title"), F.col("doc_id").alias("position"))
    ranked = m.scout_findings(m.organizer_rollup(found))
    return ranked.select("slug", "events", "name", F.get("titles", F.lit(2)).alias("third"), "confidence", "value")


@query("""SELECT CAST(sum(n) AS BIGINT) AS errors, count(*) FILTER (WHERE n > 0) AS runs_with_errors, floor((count(*) - count(*) FILTER (WHERE n > 0)) * 100.0::DOUBLE / count(*) * 10 + 0.5) / 10 AS error_free_percent,
CAST(sum(CASE WHEN started >= TIMESTAMP '2001-07-26' THEN n ELSE 0 END) AS BIGINT) AS errors_7_days FROM (SELECT o_orderdate AS started, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 3 ELSE 0 END AS n FROM orders)""")
def error_stats(spark, sf_dir):
    n = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey") % 3).otherwise(0).cast("int")
    runs_ = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("started"), F.array_repeat(F.lit("boom"), n).alias("errors"))
    return m.error_stats(runs_, "started", orders_now())


@query("SELECT role AS status, count(*) AS n FROM conversations GROUP BY 1")
def finding_counts(spark, sf_dir):
    return m.counts_by(table(spark, sf_dir, "conversations").withColumnRenamed("role", "status"), "status")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1")
def category_counts(spark, sf_dir):
    return m.counts_by(table(spark, sf_dir, "part"), "p_type")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS query_text, o_totalprice / 500000 AS priority, o_custkey % 7 AS times_run FROM orders
WHERE o_totalprice / 500000 < 0.2 AND o_custkey % 7 >= 3 ORDER BY query_text LIMIT 5""")
def stale_queries(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("query_text"), (F.col("o_totalprice") / 500000).alias("priority"), (F.col("o_custkey") % 7).alias("times_run"))
    return m.stale_queries(named)


@query("""WITH daily AS (SELECT CAST(ts AS DATE) AS day, count(*) AS decisions, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, count(*) FILTER (WHERE event_type = 'error') AS rejected FROM events GROUP BY 1)
SELECT day, decisions, accepted, rejected, CAST(floor(accepted * 100.0::DOUBLE / nullif(accepted + rejected, 0) + 0.5) AS INTEGER) AS accept_rate FROM daily""")
def flagship(spark, sf_dir):
    """Decisions by day with acceptances, rejections and the acceptance rate."""
    from calendrix.functions.semantics import pass_rate

    good, bad = F.count_if(F.col("outcome") == "accepted"), F.count_if(F.col("outcome") == "rejected")
    daily = decisions(spark, sf_dir).groupBy(F.to_date("ts").alias("day"))
    return daily.agg(F.count(F.lit(1)).alias("decisions"), good.alias("accepted"), bad.alias("rejected"), pass_rate(good, bad).alias("accept_rate"))
