"""Monitor, repair, experiment, feedback and lookup queries over the test tables, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.operators import dedup as d
from calendrix.operators import intake as i
from calendrix.operators import lookups as j
from calendrix.operators import monitoring as mo
from calendrix.operators import selection as sel
from calendrix.operators import transitions as tr
from calendrix.plans.base import events_now, orders_now, registry, table
from calendrix.plans.intake_queries import pick, picked
from calendrix.plans.state_queries import happenings
from calendrix.plans.text_queries import HOST_SQL, PATH_SQL

QUERIES, ORACLES, query = registry()

KINDS = ["deactivate_query", "create_query", "create_source_query", "boost_query", "flag_source", "add_source_context", "escalate_to_human", "skip_source", "verify_repair", "resolve_action_item", "mystery"]


def actions(spark, sf_dir):
    """orders as monitor actions, the first five of each report of about eight, with fields missing here and there."""
    n = F.col("o_orderkey")
    known = F.when(n % 4 != 0, F.concat(F.lit("query "), (n % 700).cast("string")))
    asked = table(spark, sf_dir, "orders").select(
        F.floor(n / 32).alias("report"), n.alias("pos"), pick(KINDS, n).alias("type"), known.alias("query_text"), F.when(n % 3 != 0, F.concat(F.lit("https://s.example/"), (n % 40).cast("string"))).alias("source_url"),
        F.lit("too old").alias("reason"), F.when(n % 5 != 0, F.lit("a context")).alias("context"), F.when(n % 2 == 0, F.lit("a title")).alias("title"), F.lit("why").alias("description"),
        F.lit(None).cast("string").alias("action_type"), (n % 7 == 0).alias("auto_fixable"), F.when(n % 2 == 1, n.cast("string")).alias("repair_id"), F.lit("verified").alias("verification_result"),
        F.lit(None).cast("string").alias("notes"), F.when(n % 6 != 0, n.cast("string")).alias("action_item_id"), F.lit(None).cast("string").alias("detail"),
    )
    return mo.first_actions(asked)


RESULTS = f"""WITH RECURSIVE a AS (SELECT * FROM (SELECT o_orderkey // 32 AS report, row_number() OVER (PARTITION BY o_orderkey // 32 ORDER BY o_orderkey) AS turn, o_orderkey AS pos, {picked(KINDS, 'o_orderkey')} AS type, CASE WHEN o_orderkey % 4 <> 0 THEN 'query ' || (o_orderkey % 700) END AS q, o_orderkey % 3 <> 0 AS has_url, 'https://s.example/' || (o_orderkey % 40) AS u FROM orders) WHERE turn <= 5),
k AS (SELECT DISTINCT 'query ' || (o_orderkey % 300) AS query_text, o_orderkey % 300 AS n FROM orders),
turns AS MATERIALIZED (SELECT q AS query_text, pos, type, row_number() OVER (PARTITION BY q ORDER BY pos) AS rn FROM a WHERE q IS NOT NULL AND type IN ('deactivate_query', 'create_query', 'create_source_query', 'boost_query')),
fold AS (SELECT query_text, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS pos, false AS was, n IS NOT NULL AS there, coalesce(n % 5 <> 0, false) AS is_active, n / 300::DOUBLE AS priority, CASE WHEN n IS NOT NULL THEN 'event_search' END AS query_type, CASE WHEN n IS NOT NULL THEN 'user' END AS created_by
  FROM (SELECT query_text FROM k UNION SELECT query_text FROM turns) LEFT JOIN k USING (query_text)
 UNION ALL SELECT f.query_text, t.rn, t.pos, there, there OR type LIKE 'create%', CASE WHEN type = 'deactivate_query' THEN false WHEN type LIKE 'create%' AND NOT there THEN true ELSE is_active END,
  CASE WHEN type = 'boost_query' AND is_active THEN 0.8::DOUBLE WHEN type LIKE 'create%' AND NOT there THEN CASE WHEN type = 'create_query' THEN 0.7::DOUBLE ELSE 1::DOUBLE END ELSE priority END,
  CASE WHEN type LIKE 'create%' AND NOT there THEN CASE WHEN type = 'create_query' THEN 'event_search' ELSE 'source_discovery' END ELSE query_type END, CASE WHEN type LIKE 'create%' AND NOT there THEN 'agent' ELSE created_by END
  FROM fold f JOIN turns t ON t.query_text = f.query_text AND t.rn = f.rn + 1),
r AS (SELECT a.*, CASE type WHEN 'deactivate_query' THEN 'Done' WHEN 'create_query' THEN CASE WHEN was THEN 'Skipped (already exists)' ELSE 'Created (event_search)' END
 WHEN 'create_source_query' THEN CASE WHEN was THEN 'Skipped (already exists)' ELSE 'Created (source_discovery)' END WHEN 'boost_query' THEN 'Boosted to 0.8' WHEN 'flag_source' THEN 'Flagged: too old'
 WHEN 'add_source_context' THEN CASE WHEN has_url AND pos % 5 <> 0 THEN 'Context set: "a context..."' ELSE 'Skipped (missing source_url or context)' END
 WHEN 'escalate_to_human' THEN CASE WHEN pos % 2 = 0 THEN 'Created action item (investigation, auto_fixable=' || (pos % 7 = 0) || ')' ELSE 'Skipped (missing title or description)' END
 WHEN 'skip_source' THEN CASE WHEN NOT has_url THEN 'Skipped (missing source_url)' WHEN pos % 40 < 10 THEN 'Blocked: config source' ELSE 'Source demoted' END
 WHEN 'verify_repair' THEN CASE WHEN pos % 2 = 1 THEN 'verified: no notes' ELSE 'Skipped (missing repair_id or verification_result)' END
 WHEN 'resolve_action_item' THEN CASE WHEN pos % 6 <> 0 THEN 'Resolved' ELSE 'Skipped (missing action_item_id)' END ELSE 'Skipped (unknown action type)' END AS result,
 type IN ('deactivate_query', 'create_query', 'create_source_query', 'boost_query') AS of_query FROM a LEFT JOIN fold USING (pos)),
res AS (SELECT pos, type AS action, CASE WHEN of_query THEN q WHEN has_url THEN u WHEN pos % 2 = 0 THEN 'a title' WHEN pos % 2 = 1 THEN CAST(pos AS VARCHAR) END AS detail, result, has_url, u FROM r WHERE NOT of_query OR q IS NOT NULL) """


def known_queries(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 300).alias("n")).distinct()
    return made.select(F.concat(F.lit("query "), F.col("n").cast("string")).alias("query_text"), (F.col("n") % 5 != 0).alias("is_active"), (F.col("n") / 300).alias("priority"), F.lit("event_search").alias("query_type"), F.lit("user").alias("created_by"))


def known_sources(spark, sf_dir):
    made = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("n")).distinct()
    none = F.lit(None)
    return made.select(F.concat(F.lit("https://s.example/"), F.col("n").cast("string")).alias("url"), F.when(F.col("n") < 10, "config").otherwise("probation").alias("tier"), none.cast("string").alias("validation_context"), none.cast("timestamp").alias("demoted_at"))


def results(spark, sf_dir, asked):
    none = table(spark, sf_dir, "events").select(F.lit("https://s.example/").alias("url"), F.lit("other").alias("source"), F.col("ts").alias("created_at"))
    skips = i.skip_results(asked.where("type = 'skip_source' AND source_url IS NOT NULL").select("pos", "source_url", "reason"), known_sources(spark, sf_dir), none, events_now())
    known, after = mo.folded_queries(asked, known_queries(spark, sf_dir))
    return mo.action_results(asked, known, skips.withColumn("report", F.floor(F.col("pos") / 32))), after


@query(RESULTS + "SELECT pos, action, detail, result FROM res")
def monitor_actions(spark, sf_dir):
    return results(spark, sf_dir, actions(spark, sf_dir))[0].select("pos", "action", "detail", "result")


@query(RESULTS + "SELECT query_text, is_active, priority, query_type, created_by FROM fold WHERE there QUALIFY row_number() OVER (PARTITION BY query_text ORDER BY rn DESC) = 1")
def queries_after_actions(spark, sf_dir):
    asked, queries = actions(spark, sf_dir), known_queries(spark, sf_dir)
    return mo.acted_queries(queries, mo.folded_queries(asked, queries)[1])


@query(RESULTS + """, s AS (SELECT DISTINCT 'https://s.example/' || (o_orderkey % 40) AS url, o_orderkey % 40 AS n FROM orders)
SELECT url, CASE WHEN url IN (SELECT u FROM res WHERE has_url AND result LIKE 'Context set%') THEN 'a context' END AS validation_context, CASE WHEN url IN (SELECT u FROM res WHERE has_url AND result = 'Source demoted') THEN 'demoted' WHEN n < 10 THEN 'config' ELSE 'probation' END AS tier FROM s""")
def sources_after_actions(spark, sf_dir):
    asked = actions(spark, sf_dir)
    after = mo.acted_sources(known_sources(spark, sf_dir), asked, results(spark, sf_dir, asked)[0], orders_now())
    return after.select("url", "validation_context", "tier")


SKIP_URLS = ["https://lu.ma/a", "https://lu.ma/b", "https://www.site.example/x", "https://other.example/", "https://quiet.example/", "https://meetup.com/g"]
EVENT_URLS = ["https://lu.ma/a/evt-1", "https://site.example/talk", "https://sub.other.example/1", "https://lu.ma/c"]


@query(f"""WITH a AS (SELECT page_id AS pos, {picked(SKIP_URLS, 'page_id')} AS url, {picked(['Covered elsewhere', 'no events', None], 'page_id // 6')} AS reason FROM pages),
e AS (SELECT {HOST_SQL} AS host, {PATH_SQL} || '/' AS path FROM (SELECT {picked(EVENT_URLS, 'event_id')} AS url FROM events WHERE event_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 28 DAY)),
n AS (SELECT a.pos, count(*) AS recent FROM (SELECT *, {HOST_SQL} AS host, regexp_replace({PATH_SQL}, '/$', '') || '/' AS root FROM a) a JOIN e ON a.host = e.host WHERE a.host NOT IN ('lu.ma', 'meetup.com') OR starts_with(e.path, a.root) GROUP BY 1)
SELECT pos, url AS source_url, CASE WHEN url = 'https://other.example/' THEN 'Blocked: config source' WHEN url LIKE '%lu.ma%' AND contains(lower(reason), 'covered') OR url LIKE '%meetup.com%' AND contains(lower(reason), 'covered') THEN 'Blocked: shared platform'
WHEN recent > 0 THEN 'Blocked: recent web-search events' ELSE 'Source demoted' END AS result FROM a LEFT JOIN n USING (pos)""")
def skip_guardrails(spark, sf_dir):
    n = F.col("page_id")
    asked = table(spark, sf_dir, "pages").select(n.alias("pos"), pick(SKIP_URLS, n).alias("source_url"), pick(["Covered elsewhere", "no events", None], F.floor(n / 6)).alias("reason"))
    events = table(spark, sf_dir, "events").select(pick(EVENT_URLS, F.col("event_id")).alias("url"), F.when(F.col("event_id") % 3 == 0, "web-search").otherwise("luma").alias("source"), F.col("ts").alias("created_at"))
    sources = spark.createDataFrame([("https://other.example/", "config"), ("https://lu.ma/a", "probation")], "url string, tier string")
    return i.skip_results(asked, sources, events, events_now())


@query("""WITH RECURSIVE v AS MATERIALIZED (SELECT o_orderkey % 3000 AS item, CASE WHEN o_custkey % 3 = 0 THEN 'failed' ELSE 'verified' END AS said, row_number() OVER (PARTITION BY o_orderkey % 3000 ORDER BY o_custkey, o_orderkey) AS rn FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0),
h AS (SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS rn, 'attempted' AS repair_status, o_orderstatus = 'F' AS is_resolved FROM orders UNION ALL SELECT id, v.rn, said, is_resolved OR said = 'verified' FROM h JOIN v ON item = id AND v.rn = h.rn + 1)
SELECT id, repair_status, is_resolved FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1""")
def repair_verification(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = orders.select(F.col("o_orderkey").alias("id"), F.lit("attempted").alias("repair_status"), (F.col("o_orderstatus") == "F").alias("is_resolved"))
    none = F.lit(None).cast("string")
    repairs = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 3000).alias("action_item_id"), none.alias("verification_result"), none.cast("timestamp").alias("verified_at"))
    said = orders.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("repair_id"), F.when(F.col("o_custkey") % 3 == 0, "failed").otherwise("verified").alias("result"), F.struct("o_custkey", "o_orderkey").alias("pos"))
    return mo.verified_repairs(items, repairs, said, orders_now())[0]


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND (o_custkey % 4 = 0 OR o_orderdate < TIMESTAMP '2001-08-01')""")
def repair_queue(spark, sf_dir):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "proposed").when(F.col("o_orderpriority") == "2-HIGH", "rolled_back").otherwise("pending")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_resolved"), status.alias("repair_status"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderdate")).alias("last_failure_at"))
    return mo.open_queue(items, orders_now()).select("id")


@query("""SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, id LIMIT 5""")
def proposed_queue(spark, sf_dir):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "proposed").otherwise("pending")
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("is_resolved"), status.alias("repair_status"), F.col("o_orderdate").alias("proposed_at"))
    return mo.proposed_queue(items).select("id")


@query("""SELECT c_custkey AS id, coalesce(n, 0) AS repairs, coalesce(good, 0) AS verified FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS good FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def repairs_of_items(spark, sf_dir):
    result = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "failed")
    repairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("action_item_id"), result.alias("verification_result"))
    return mo.repaired_items(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), repairs.where("verification_result IS NOT NULL"))


@query("SELECT count(*) AS waiting FROM orders WHERE o_orderstatus = 'P'")
def unverified_repairs(spark, sf_dir):
    repairs = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("verification_result"))
    return mo.unverified(repairs).agg(F.count(F.lit(1)).alias("waiting"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 OR n IS NULL THEN CASE WHEN c_custkey % 3 = 0 THEN 'completed' ELSE 'pending' END ELSE 'completed' END AS status,
CASE WHEN c_custkey % 3 = 0 OR n IS NULL THEN NULL ELSE n || ' sources, ' || events || ' events, ' || errors || ' errors' END AS summary FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 5) AS events, count(*) FILTER (WHERE o_orderstatus = 'F') AS errors FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def plan_completion(spark, sf_dir):
    none = F.lit(None).cast("string")
    plans = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "completed").otherwise("pending").alias("status"), none.alias("execution_summary"), none.cast("timestamp").alias("completed_at"))
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan_id"), (F.col("o_orderkey") % 5).alias("events"), (F.col("o_orderstatus") == "F").cast("int").alias("errors"))
    return mo.completed_plan(plans, "*", runs, orders_now()).select("id", "status", F.col("execution_summary").alias("summary"))


@query("""WITH due AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate + INTERVAL 3 DAY <= TIMESTAMP '2001-08-02' ORDER BY o_orderdate, o_orderkey LIMIT 20)
SELECT o_orderkey AS id, CASE WHEN due.id IS NOT NULL AND o_orderkey % 3 <> 0 OR o_orderstatus <> 'O' THEN 'evaluated' ELSE 'pending' END AS status, CASE WHEN due.id IS NOT NULL AND o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 2 = 0 AS VARCHAR) END AS hit FROM orders LEFT JOIN due ON due.id = o_orderkey""")
def experiment_lifecycle(spark, sf_dir):
    """The oldest due experiments, all but a third of which get a verdict."""
    none = F.lit(None)
    made = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("evaluated").alias("status"), none.cast("boolean").alias("outcome_match"), none.cast("double").alias("confidence_delta"),
        none.cast("timestamp").alias("evaluated_at"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("evaluate_after"),
    )
    said = mo.due_experiments(made, orders_now()).where("id % 3 <> 0").select("id", (F.col("id") % 2 == 0).alias("hit"), F.lit(0.1).alias("delta"))
    return mo.evaluated(made, said, orders_now()).select("id", "status", F.col("outcome_match").cast("string").alias("hit"))


@query("""SELECT 'Source "' || p_name || '" (https://p.example/' || p_partkey || ') will produce ' || (p_size % 4) || '+ events per scrape' AS hypothesis, (p_size % 4) || '+ events per scrape, parser: luma' AS prediction, CAST(3 AS INTEGER) AS evaluation_window_runs, 'pending' AS status FROM part WHERE p_size % 4 > 0""")
def scout_hypotheses(spark, sf_dir):
    probes = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("https://p.example/"), F.col("p_partkey").cast("string")).alias("url"), (F.col("p_size") % 4).alias("events"), F.lit("luma").alias("scraper"))
    return mo.hypotheses(probes, orders_now()).select("hypothesis", "prediction", "evaluation_window_runs", "status")


ESCALATED = """WITH r AS (SELECT user_id AS source, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS events, event_type = 'view' AS parse FROM events),
 i AS (SELECT *, sum(events) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, sum(events) OVER (PARTITION BY source) AS last FROM r),
 c AS (SELECT source, count(*) FILTER (WHERE island = last AND parse) AS n FROM i GROUP BY 1 HAVING count(*) FILTER (WHERE island = last AND parse) >= 3)"""


@query(ESCALATED + """ SELECT 'Parser failing: ' || source AS title, n || ' parse failures in a row' AS description, 'warning' AS severity, 'code_fix' AS action_type, true AS auto_fixable, 'pending' AS repair_status FROM c
UNION ALL SELECT 'item ' || p_partkey, 'd', CASE WHEN p_size % 3 = 0 THEN 'critical' ELSE 'info' END, CASE WHEN p_size % 2 = 0 THEN 'code_fix' ELSE 'investigation' END, p_size % 5 = 0, 'pending' FROM part""")
def action_items(spark, sf_dir):
    """Items of parsers that keep failing, and of a report's escalations with their defaults."""
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), "ts", "event_id", F.when(F.col("event_type") == "purchase", 1).otherwise(0).cast("bigint").alias("events"),
        F.when(F.col("event_type") == "view", "parse_uncertain").otherwise("success").alias("status"), F.lit(200).alias("http_status"), F.lit(False).alias("keywords"), F.lit(False).alias("is_config"),
    )
    n = F.col("p_size")
    asked = table(spark, sf_dir, "part").select(
        F.concat(F.lit("item "), F.col("p_partkey").cast("string")).alias("title"), F.lit("d").alias("description"), F.when(n % 3 == 0, "critical").otherwise("").alias("severity"), F.lit(None).cast("string").alias("category"),
        F.when(n % 2 == 0, "code_fix").alias("action_type"), F.when(n % 5 == 0, True).alias("auto_fixable"),
    )
    made = mo.new_items(mo.parse_escalations(tr.scrape_counters(runs, ["ts", "event_id"])).unionByName(asked), orders_now())
    return made.select("title", "description", "severity", "action_type", "auto_fixable", "repair_status")


CONFIG_URLS = ["https://lu.ma/austin-ai/extra", "https://www.site.example/list/", "https://meetup.com/", "https://luma.com/x?y=1"]


@query(f"""SELECT lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) AS normal FROM pages UNION SELECT unnest(['lu.ma/austin-ai/extra', 'site.example/list', 'meetup.com', 'luma.com/x', 'lu.ma/austin-ai', 'luma.com/x'])""")
def known_url_set(spark, sf_dir):
    config = spark.createDataFrame([(x,) for x in CONFIG_URLS], "url string")
    return mo.known_urls(table(spark, sf_dir, "pages"), config)


@query(f"""WITH k AS (SELECT DISTINCT lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) AS normal FROM pages WHERE page_id % 3 = 0)
SELECT page_id, normal FROM (SELECT page_id, lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) AS normal, row_number() OVER (PARTITION BY lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1 AND normal NOT IN (FROM k)""")
def unknown_results(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return j.new_urls(pages, pages.where("page_id % 3 = 0"), "page_id").select("page_id", "normal")


@query(f"""WITH p AS (SELECT page_id AS id, lower(url) AS url, lower('Page ' || page_id || ' about ' || (page_id % 20)) AS title FROM pages), a AS (SELECT page_id AS id, CASE WHEN page_id % 5 = 0 THEN 'x' WHEN page_id % 2 = 0 THEN lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) ELSE 'nowhere.example/' || page_id END AS needle,
 CASE WHEN page_id % 3 = 0 THEN 'page ' || (page_id // 10) WHEN page_id % 3 = 1 THEN 'no such title' END AS title FROM pages)
SELECT a.id, min(p.id) AS found_id FROM a LEFT JOIN p ON contains(p.url, a.needle) OR contains(p.title, a.title) GROUP BY 1""")
def event_lookup(spark, sf_dir):
    """Submissions held against events by URL or the beginning of a title, in any case."""
    n = F.col("page_id")
    pages = table(spark, sf_dir, "pages")
    events = pages.select(n.alias("id"), "url", F.concat(F.lit("Page "), n.cast("string"), F.lit(" about "), (n % 20).cast("string")).alias("title"))
    url = F.when(n % 5 == 0, "x").when(n % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("https://nowhere.example/"), n.cast("string")))
    asked = pages.select(n.alias("id"), url.alias("url"), F.when(n % 3 == 0, F.concat(F.lit("PAGE "), F.floor(n / 10).cast("string"))).when(n % 3 == 1, "no such title").alias("title"))
    return mo.found_events(asked, events).select("id", "found_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size % 2 = 0 AS VARCHAR) END AS was_found, p_partkey % 3 <> 0 AS analysis_complete, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'added source' END AS actions FROM part""")
def feedback_completion(spark, sf_dir):
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    said = part.where("p_partkey % 3 <> 0").select(n.alias("id"), F.lit(True).alias("source_known"), F.when(F.col("p_size") % 2 == 0, n).alias("found_id"), F.lit("off topic").alias("likely_reason"), F.array(F.lit("added source")).alias("actions"))
    done = mo.completed_feedback(part.select(n.alias("id")), said, orders_now())
    return done.select("id", F.col("was_found").cast("string").alias("was_found"), "analysis_complete", F.array_join("actions_taken", ",").alias("actions"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_orderdate END AS last_success, CASE WHEN o_orderkey % 7 = 0 THEN 'config' WHEN o_orderkey % 7 = 1 THEN 'demoted' WHEN o_orderkey % 3 = 0 THEN 'probation' WHEN o_orderkey % 3 = 1 THEN 'probation' ELSE 'demoted' END AS tier FROM orders""")
def backfills(spark, sf_dir):
    """Columns that were introduced later: the last success of queries and the tier of sources."""
    n = F.col("o_orderkey")
    url = F.when(n % 7 == 0, "https://c.example/").when(n % 7 == 1, "https://www.meetup.com/find/?q=ai").otherwise("https://x.example/")
    tier = tr.backfilled_tier(url, pick(["trusted", None, "demoted"], n), ["https://c.example/"])
    return table(spark, sf_dir, "orders").select("o_orderkey", mo.first_success(F.col("o_custkey") % 3, F.col("o_orderdate"), F.lit(None).cast("timestamp")).alias("last_success"), tier.alias("tier"))


@query("""SELECT o_orderkey AS id, o_custkey % 4 + coalesce(n, 0) AS times_run, CAST(o_custkey % 3 + coalesce(found, 0) AS BIGINT) AS sources_found, CASE WHEN coalesce(found, 0) > 0 THEN 1::DOUBLE ELSE 0.25::DOUBLE END AS priority FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(CAST(l_linenumber % 3 AS BIGINT)) AS found FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def query_stats(spark, sf_dir):
    queries = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 4).alias("times_run"), (F.col("o_custkey") % 3).alias("sources_found"), F.lit(0.25).alias("priority"), F.lit(None).cast("timestamp").alias("last_success"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).cast("bigint").alias("found"))
    return tr.run_queries(queries, found, orders_now()).select("id", "times_run", "sources_found", "priority")


@query("""SELECT c_custkey AS url, c_custkey % 4 = 0 AS planned FROM customer WHERE c_custkey % 3 <> 0""")
def plan_partition(spark, sf_dir):
    """Due sources in a plan and beside it, put together again."""
    sources = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("url"))
    inside, outside = j.split_by_plan(sources, table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(F.col("c_custkey").alias("url")))
    both = j.union_all(inside, outside.withColumn("left_out", F.lit(True)))
    return both.select("url", (F.col("stream") == 0).alias("planned"))


@query("""SELECT o_orderkey AS url FROM orders WHERE o_orderkey % 5 <> 2 AND o_custkey % 9 <> 4 ORDER BY CASE WHEN o_orderkey % 500 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, url LIMIT 12""")
def rotation(spark, sf_dir):
    """The sources that were scraped longest ago, of those in use."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "url")
    rows = orders.where(~(F.col("url") % 5).isin(2) & (F.col("o_custkey") % 9 != 4)).withColumn("last_run", F.when(F.col("url") % 500 != 0, F.col("o_orderdate")))
    return sel.longest_unseen(rows, "last_run", "url", 12).select("url")


@query("""WITH RECURSIVE m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey - 1 END AS into_id FROM part), c AS (SELECT id, into_id AS target FROM m WHERE into_id IS NOT NULL UNION ALL SELECT c.id, m.into_id FROM c JOIN m ON m.id = c.target WHERE m.into_id IS NOT NULL)
SELECT id, min(target) AS target FROM c GROUP BY 1""")
def merge_chains(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_partkey") - 1).alias("merged_into_id"))
    return d.merge_targets(rows)


NEAR_EVENTS = """WITH h AS (SELECT event_id AS id, event_type || ' ' || (user_id % 20) AS title, CASE WHEN event_id % 50 < 2 THEN date_trunc('day', ts) ELSE ts END AS start,
  CASE WHEN event_id % 9 = 0 THEN 'The Venue Hall ' || (user_id % 5) || ', East' WHEN event_id % 3 = 0 THEN 'Venue Hall ' || (user_id % 5) END AS venue, regexp_replace(lower(coalesce(venue, '')), '[^a-z0-9]', '', 'g') AS print FROM events)
SELECT a.id AS a_id, b.id AS b_id FROM h a JOIN h b ON a.id <> b.id AND abs(date_sub('hour', a.start, b.start)) <= 48 WHERE
 {titles} abs(date_sub('hour', a.start, b.start)) <= 3 AND a.print <> '' AND b.print <> '' AND (contains(a.print, b.print) OR contains(b.print, a.print)) OR abs(date_sub('hour', a.start, b.start)) <= 1 AND a.venue IS NULL AND b.venue IS NULL"""


@query(NEAR_EVENTS.format(titles="levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title), 1)::DOUBLE <= 0.45 OR"))
def reconciler_pairs(spark, sf_dir):
    """What the reconciler puts side by side, at its own likeness of titles."""
    return d.reconciler_edges(happenings(spark, sf_dir))


@query("""SELECT CAST(400 AS BIGINT) AS groups, count(*) FILTER (WHERE p_size % 3 <> 0 AND p_partkey % 10 > 2 AND p_partkey % 7 <> 0) AS proposals, CAST(0 AS BIGINT) AS executed, count(*) FILTER (WHERE NOT (p_size % 3 <> 0 AND p_partkey % 10 > 2 AND p_partkey % 7 <> 0)) AS skipped, count(*) AS api_calls FROM part""".replace("CAST(400 AS BIGINT)", "(SELECT count(DISTINCT p_partkey // 5) FROM part)"))
def reconciler_report(spark, sf_dir):
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    proposals = d.merge_gate(part.select((F.col("p_size") % 3 != 0).alias("is_duplicate"), F.when(n % 10 > 2, 0.9).otherwise(0.5).alias("confidence"), F.when(n % 7 != 0, n).alias("canonical_id")))
    return d.reconciler_report(part.select(F.floor(n / 5).alias("head")), proposals)
