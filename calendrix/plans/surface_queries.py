"""Parsers by type and what is called from SQL, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions.text import visitor_type
from calendrix.operators import transitions
from calendrix.plans.base import events_now, registry, table
from calendrix.plans.extract_queries import laid_out, pages
from calendrix.plans.intake_queries import pick, picked
from calendrix.sources import parsers, sql, updates

QUERIES, ORACLES, query = registry()

TYPES = ["local-cards", "date-range", "no such type", None]
MIXED = [
    '<script type="application/ld+json">{"@type":"Event","name":"Ld talk","startDate":"2030-01-01T10:00:00-05:00","url":"https://a.example/1"}</script><p>February 10-11, 2030</p>',
    '<div class="event-card"><h3>Card talk</h3><a href="/c/1">go</a><time datetime="2030-01-01T10:00:00Z">x</time></div><p>on february 10-12, 2030</p>',
    "<p>Nothing but text, March 3, 2031</p>",
]


@query(f"""WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS source, page_id % 3 AS page, {picked(TYPES, 'page_id // 3')} AS type FROM pages)
SELECT page_id, CASE WHEN type IN ('local-cards', 'date-range') THEN type ELSE 'scrape' END AS scraper, CASE WHEN page = 2 AND coalesce(type, '') <> 'date-range' THEN 'parse_uncertain' ELSE 'success' END AS status,
CASE WHEN page = 0 THEN 'Ld talk' WHEN page = 1 AND coalesce(type, '') <> 'date-range' THEN 'Card talk' WHEN type = 'date-range' THEN source END AS title,
CASE WHEN page = 0 AND type = 'local-cards' THEN '2030-01-01T16:00:00Z' WHEN page = 0 THEN '2030-01-01T10:00:00-05:00' WHEN page = 1 AND type = 'local-cards' THEN '2030-01-01T16:00:00Z'
 WHEN page = 1 AND type = 'date-range' THEN '2030-02-10' WHEN page = 1 THEN '2030-01-01T10:00:00Z' WHEN type = 'date-range' THEN '2031-03-03' END AS start_time,
CASE WHEN page = 1 AND type = 'date-range' THEN '2030-02-12' WHEN page = 2 AND type = 'date-range' THEN '2031-03-03' END AS end_time, 'probation' AS source_tier FROM p""")
def inline_probe(spark, sf_dir):
    """Every page read by the parser of its type; the same page gives other events to another one."""
    rows = pages(spark, sf_dir).withColumns({"html": pick(MIXED, F.col("page_id"))})
    found = parsers.probed(rows, pick(TYPES, F.floor(F.col("page_id") / 3)))
    return found.select("page_id", "scraper", "status", "title", "start_time", "end_time", "source_tier")


@query("""SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'parse_uncertain' ELSE 'success' END AS status, CAST([1, 1, 2, 2, 2, 0][CAST(page_id % 6 AS INTEGER) + 1] AS BIGINT) AS events,
[['Ld talk'], ['Next talk'], ['Array talk', 'Array two'], ['Card talk', 'Card two'], ['Link talk one', 'Link two'], []][CAST(page_id % 6 AS INTEGER) + 1][:1] AS sample FROM pages""")
def parser_trial(spark, sf_dir):
    """One parser run over the pages, with its result and the first title."""
    return parsers.tried(laid_out(spark, sf_dir), "generic", 1).select("page_id", "status", "events", "sample")


AGENTS = ["Mozilla/5.0 (X11; Linux)", "GPTBot/1.0", "Googlebot/2.1", "Mozilla/5.0 claudebot", None]


def views(spark, sf_dir):
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("/p"), (F.col("user_id") % 7).cast("string")).alias("page"), pick(AGENTS, n).alias("user_agent"), F.col("ts").alias("created_at"))
    return rows.withColumn("visitor_type", visitor_type(F.col("user_agent")))


VIEWS = f"""WITH v AS (SELECT '/p' || (user_id % 7) AS page, {picked(AGENTS, 'event_id')} AS agent, CASE WHEN event_id % 5 IN (1, 2, 3) THEN 'bot' ELSE 'human' END AS kind, CAST(ts AS DATE) AS day FROM events),
asked AS (SELECT unnest(['/p1', '/p3', '/p1', '/none']) AS page, unnest(['human', 'bot', 'bot', 'human']) AS kind) """


@query(VIEWS + """SELECT page, kind AS type, (SELECT count(*) FROM (SELECT DISTINCT day, agent FROM v WHERE v.page = asked.page AND v.kind = asked.kind)) AS visitors,
(SELECT count(*) FROM v WHERE v.page = asked.page AND v.kind = 'bot' AND regexp_matches(agent, '(?i)gptbot|claudebot')) AS ai_visits FROM asked""")
def sql_functions(spark, sf_dir):
    """Both visitor functions, called for a table of pages and types."""
    events = table(spark, sf_dir, "events").withColumn("start_time", F.col("ts"))
    sql.register(spark, views(spark, sf_dir), events, events_now())
    calls = [("/p1", "human"), ("/p3", "bot"), ("/p1", "bot"), ("/none", "human")]
    return spark.sql(" UNION ALL ".join(
        f"SELECT '{p}' AS page, '{t}' AS type, u.visitors, a.visits AS ai_visits FROM unique_visitor_count('{p}', '{t}') u CROSS JOIN ai_crawler_count('{p}') a" for p, t in calls
    ))


@query("SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND event_type <> 'view'")
def upcoming_view(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("start_time", F.col("ts"))
    sql.register(spark, views(spark, sf_dir), events, F.lit("2024-01-25").cast("timestamp"))
    return spark.sql("SELECT event_id, event_type FROM upcoming_events WHERE event_type <> 'view'")


@query("""WITH p AS (SELECT page_id, DENSE_RANK() OVER (PARTITION BY 1 ORDER BY url) AS n, url FROM pages), had AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 = 0)
SELECT url, had.url IS NULL AS added FROM (SELECT DISTINCT url FROM pages) LEFT JOIN had USING (url)""")
def insert_if_absent(spark, sf_dir):
    """Sources by URL: those of every third page are there, the rest is added once each."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url")
    known = rows.where("page_id % 3 = 0").select("url").distinct().withColumn("added", F.lit(False))
    return transitions.insert_absent(known, rows.withColumn("added", F.lit(True)), "url", "page_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'unchanged' ELSE 'updated' END AS change FROM orders WHERE o_orderkey % 64 < 3 AND o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 'inserted' FROM orders WHERE o_orderkey % 64 < 3 AND o_orderkey % 2 = 1""")
def upsert_changes(spark, sf_dir):
    """What an upsert in place makes of each row that comes in."""
    import uuid

    from calendrix.operators.kept import checkpointed

    checkpointed(spark)
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    state = orders.where("id % 2 = 0").withColumn("updated_at", events_now())
    path = f"{spark.sparkContext.getCheckpointDir()}/upsert-{uuid.uuid4().hex}"
    updates.create(state, path, ["id"])
    news = orders.where("id % 64 < 3").withColumns({"price": F.when(F.col("id") % 4 == 0, F.col("price")).otherwise(F.col("price") + 1), "arrival": F.col("id")})
    return updates.upsert_into(path, news, ["id"], "arrival", events_now(), state.withColumn("bucket", F.lit(0)).schema)
