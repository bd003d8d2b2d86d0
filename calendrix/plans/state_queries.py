"""Duplicate, join, ranking and state queries over the test tables, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions.urls import host
from calendrix.operators import dedup as d
from calendrix.operators import lookups as j
from calendrix.operators import selection as sel
from calendrix.operators import transitions as tr
from calendrix.plans.base import orders_now, table
from calendrix.plans.text_queries import HOST_SQL, NORM

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def happenings(spark, sf_dir):
    """events as calendar entries: type as title, user as source, a venue of every third (a part of
    another's name for some), a date without a time for every fiftieth, and arrival in mixed order."""
    hall = (F.col("user_id") % 5).cast("string")
    venue = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("The Venue Hall "), hall, F.lit(", East"))).when(F.col("event_id") % 3 == 0, F.concat(F.lit("Venue Hall "), hall))
    start = F.when(F.col("event_id") % 50 < 2, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat_ws(" ", "event_type", (F.col("user_id") % 20).cast("string")).alias("title"), start.alias("start"),
        (F.col("user_id") % 7).cast("string").alias("source"), venue.alias("venue"), F.lit(None).cast("string").alias("address"), (F.col("event_id") * 7919 % 10007).alias("arrival"),
        F.when(F.col("event_id") % 8 < 2, F.concat(F.lit("https://a.example/e/"), F.floor(F.col("event_id") / 8).cast("string"))).otherwise(F.concat(F.lit("https://a.example/own/"), F.col("event_id").cast("string"))).alias("url"),
        F.when(F.col("event_id") % 25 == 3, F.floor(F.col("event_id") / 50).cast("string")).alias("source_event_id"),
    )


HAPPENINGS = """WITH h AS (SELECT event_id AS id, event_type || ' ' || (user_id % 20) AS title, CASE WHEN event_id % 50 < 2 THEN date_trunc('day', ts) ELSE ts END AS start, CAST(user_id % 7 AS VARCHAR) AS source,
  CASE WHEN event_id % 9 = 0 THEN 'The Venue Hall ' || (user_id % 5) || ', East' WHEN event_id % 3 = 0 THEN 'Venue Hall ' || (user_id % 5) END AS venue, event_id * 7919 % 10007 AS arrival,
  CASE WHEN event_id % 8 < 2 THEN 'https://a.example/e/' || (event_id // 8) ELSE 'https://a.example/own/' || event_id END AS url, CASE WHEN event_id % 25 = 3 THEN CAST(event_id // 50 AS VARCHAR) END AS source_event_id, strftime(start, '%H:%M:%S') = '00:00:00' AS dated, CAST(start AS DATE) AS day,
  regexp_replace(lower(coalesce(venue, '')), '[^a-z0-9]', '', 'g') AS print FROM events), a AS (SELECT * FROM h WHERE id % 2 = 0), b AS (SELECT * FROM h WHERE id % 2 = 1) """


def halves(spark, sf_dir):
    """New and existing entries: a full-table split in two roles."""
    rows = happenings(spark, sf_dir)
    return rows.where("id % 2 = 0"), rows.where("id % 2 = 1")


@query(HAPPENINGS + f"""SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON {NORM.format('a.title')} = {NORM.format('b.title')} AND abs(date_sub('hour', a.start, b.start)) <= 12""")
def exact_title_12h(spark, sf_dir):
    return d.exact_title_pairs(*halves(spark, sf_dir)).select("a_id", "b_id")


@query(HAPPENINGS + """SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.title = b.title AND a.venue = b.venue AND abs(date_sub('hour', a.start, b.start)) <= 48""")
def title_venue_48h(spark, sf_dir):
    return d.title_venue_pairs(*halves(spark, sf_dir)).select("a_id", "b_id")


def _first3(what: str) -> str:
    """The first three of each a by arrival, of the pairs that `what` makes."""
    return f"SELECT a_id, b_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY b.arrival, b.id) AS rank {what}) WHERE rank <= 3"


NEAR = "CASE WHEN a.dated OR b.dated THEN a.day = b.day ELSE abs(date_sub('hour', a.start, b.start)) <= {} END"
OVERLAP = "a.print <> '' AND b.print <> '' AND (contains(a.print, b.print) OR contains(b.print, a.print))"
SAME_DAY = "FROM a JOIN b ON a.source = b.source AND a.day = b.day"
CROSS = f"FROM a JOIN b ON a.source <> b.source AND {OVERLAP} AND {NEAR.format(3)}"
FALLBACK = f"""FROM a JOIN b ON a.source <> b.source AND (a.venue IS NULL OR b.venue IS NULL) AND {NEAR.format(1)} AND abs(date_sub('hour', a.start, b.start)) <= 1 WHERE a.id NOT IN (SELECT a.id {CROSS})"""


@query(HAPPENINGS + _first3(SAME_DAY))
def same_source_day_top3(spark, sf_dir):
    return d.same_source_day(*halves(spark, sf_dir))


@query(HAPPENINGS + _first3(CROSS))
def cross_source_band(spark, sf_dir):
    return d.cross_source(*halves(spark, sf_dir))


@query(HAPPENINGS + _first3(FALLBACK))
def cross_source_fallback(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return d.cross_source_fallback(a, b, d.cross_source(a, b))


@query("""WITH h AS (SELECT p_partkey AS id, lower(p_name) AS title, TIMESTAMP '2024-01-01' + INTERVAL (p_partkey % 97) HOUR AS start FROM part)
SELECT a.id AS a_id, b.id AS b_id, round(levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title), 1)::DOUBLE, 4) AS score FROM h a JOIN h b
ON a.id <> b.id AND abs(date_sub('hour', a.start, b.start)) <= 2 WHERE levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title), 1)::DOUBLE <= 0.4""")
def fuzzy_title_pairs(spark, sf_dir):
    start = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("p_partkey") % 97).cast("int"))
    h = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), start.alias("start"))
    return d.fuzzy_pairs(h, h, hours=2, digits=4).select("a_id", "b_id", "score")


def _verdicts(found):
    """Two in three candidates of layers 2 to 4 are no duplicates."""
    ids = found.where("layer >= 2").select(F.col("id").alias("left_id"), F.col("match_id").alias("right_id")).distinct()
    return ids.withColumns({"ok": (F.col("left_id") + F.col("right_id")) % 9 == 0, "confidence": F.when(F.col("left_id") % 4 == 0, 0.6).otherwise(0.9)})


DISTANCE = "levenshtein(a.title, b.title) / greatest(length(a.title), length(b.title), 1)::DOUBLE"


CASCADE = HAPPENINGS.replace("a AS (SELECT * FROM h WHERE id % 2 = 0)", "n AS (SELECT * FROM h WHERE id % 2 = 0)") + f""",
u AS (SELECT url, first(id ORDER BY arrival, id) AS m FROM b GROUP BY 1), k AS (SELECT source, source_event_id, last(id ORDER BY arrival, id) AS m FROM b WHERE source_event_id IS NOT NULL GROUP BY 1, 2),
zero AS (SELECT n.id, coalesce(u.m, k.m) AS match_id FROM n LEFT JOIN u ON u.url = n.url LEFT JOIN k ON k.source = n.source AND k.source_event_id = n.source_event_id WHERE coalesce(u.m, k.m) IS NOT NULL),
a AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM zero)),
c AS (SELECT id, match_id, 0 AS layer, 0::DOUBLE AS place, true AS sure FROM zero
 UNION ALL SELECT a.id, b.id, 1, b.arrival, true FROM a JOIN b ON a.title = b.title AND abs(date_sub('hour', a.start, b.start)) <= 12
 UNION ALL SELECT a.id, b.id, 1, b.arrival, true FROM a JOIN b ON a.title = b.title AND a.venue = b.venue AND abs(date_sub('hour', a.start, b.start)) <= 48
 UNION ALL SELECT a_id, b_id, 2, rank, false FROM ({_first3(SAME_DAY)})
 UNION ALL SELECT a_id, b_id, 3, rank, false FROM ({_first3(CROSS)})
 UNION ALL SELECT a_id, b_id, 3, rank, false FROM ({_first3(FALLBACK)})
 UNION ALL SELECT a_id, b_id, 4, rank, false FROM (SELECT a.id AS a_id, b.id AS b_id, row_number() OVER (PARTITION BY a.id ORDER BY {DISTANCE}, b.arrival, b.id) AS rank
   FROM a JOIN b ON abs(date_sub('hour', a.start, b.start)) <= 24 AND {DISTANCE} <= 0.4) WHERE rank <= 3),
j AS (SELECT *, sure OR ((id + match_id) % 9 = 0 AND id % 4 <> 0) AS taken FROM c)
SELECT n.id, match_id, CAST(layer AS INTEGER) AS layer, CAST(n_candidates AS INTEGER) AS n_candidates FROM n LEFT JOIN (
 SELECT id, first(match_id ORDER BY layer, place, match_id) FILTER (WHERE taken) AS match_id, first(layer ORDER BY layer, place, match_id) FILTER (WHERE taken) AS layer,
  count(DISTINCT layer || ':' || place || ':' || match_id) AS n_candidates FROM j GROUP BY 1) USING (id)"""


@query(CASCADE)
def dedup_cascade(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    found = d.candidates(a, b)
    return d.cascade(a, b, _verdicts(found), found=found).select("id", "match_id", "layer", F.size("candidates").alias("n_candidates"))


KEYED = r"lower(split_part(regexp_replace(url, '/$', ''), '?', 1))"


@query(f"SELECT page_id, url_key FROM (SELECT page_id, {KEYED} AS url_key, row_number() OVER (PARTITION BY {KEYED} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def url_dedup_first(spark, sf_dir):
    from calendrix.functions.urls import event_url_key

    keyed = table(spark, sf_dir, "pages").select("page_id", event_url_key(F.col("url")).alias("url_key"))
    return d.dedupe_first(keyed, "url_key", "page_id")


@query("""WITH e AS (SELECT l_orderkey AS id, 's' || l_suppkey || '|' || (l_partkey % 50) AS k, l_linenumber * 1000 + l_partkey % 1000 AS r FROM lineitem WHERE l_linenumber > 2),
last AS (SELECT k, max_by(id, id * 10000 + r) AS existing_id FROM e GROUP BY 1), n AS (SELECT l_orderkey * 10 + l_linenumber AS id, 's' || l_suppkey || '|' || (l_partkey % 50) AS k FROM lineitem WHERE l_linenumber <= 2)
SELECT n.id, coalesce(existing_id, -1) AS existing_id, CASE WHEN existing_id IS NOT NULL THEN 'source_event_id' END AS signal FROM n LEFT JOIN last USING (k)""")
def id_key_match(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    keys = {"source": F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), "source_event_id": (F.col("l_partkey") % 50).cast("string"), "url": F.lit(None).cast("string")}
    number = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    new = items.where("l_linenumber <= 2").select(number.alias("id"), *[c.alias(n) for n, c in keys.items()])
    arrival = F.col("l_orderkey") * 10_000 + F.col("l_linenumber") * 1000 + F.col("l_partkey") % 1000
    old = items.where("l_linenumber > 2").select(F.col("l_orderkey").alias("id"), arrival.alias("arrival"), *[c.alias(n) for n, c in keys.items()])
    return d.match_existing(new, old).select("id", F.coalesce("existing_id", F.lit(-1)).alias("existing_id"), "signal")


@query("""WITH l AS (SELECT o_orderkey AS id, o_custkey AS canonical_id, o_orderdate, o_orderkey AS rank, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS venue FROM orders)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, min_by(venue, rank) FILTER (WHERE venue <> '')) AS venue FROM customer LEFT JOIN l ON canonical_id = c_custkey GROUP BY c_custkey, c_mktsegment""")
def merge_backfill(spark, sf_dir):
    """Customers take what their orders, as losing duplicates, know; the canonical rows are shown."""
    stamp, none = F.lit(None).cast("timestamp"), F.lit(None).cast("bigint")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("venue"), stamp.alias("deleted_at"), none.alias("merged_into_id"))
    orders = table(spark, sf_dir, "orders")
    own = orders.select((F.col("o_orderkey") + 10**9).alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("venue"), stamp.alias("deleted_at"), none.alias("merged_into_id"))
    losers = orders.select((F.col("o_orderkey") + 10**9).alias("id"), F.col("o_custkey").alias("canonical_id"), F.col("o_orderkey").alias("rank"))
    return d.merged(owners.union(own), losers, ["venue"], orders_now()).where("deleted_at IS NULL").select("id", "venue")


@query("""SELECT c_custkey AS url, 'planned' AS reason FROM customer WHERE c_custkey % 3 = 0 UNION ALL
SELECT c_custkey, CASE WHEN last IS NULL THEN 'never scraped' ELSE 'last scraped ' || date_diff('day', CAST(last AS DATE), DATE '2001-08-02') || ' days ago' END
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0""")
def floor_due(spark, sf_dir):
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("url")).agg(F.max("o_orderdate").alias("last_scraped"))
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url")).join(last, "url", "left")
    return j.floor_rule(sources, sources.where("url % 3 = 0").select("url"), orders_now())


@query(r"""WITH p AS (SELECT page_id, regexp_extract(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)', 2), '/+([^/]+)', 1) AS slug FROM pages)
SELECT page_id, slug FROM p WHERE slug <> '' AND slug NOT IN (SELECT slug FROM p WHERE page_id % 10 = 0 AND slug <> 'en')""")
def unknown_sources(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return j.unknown_organizers(pages, pages.where("page_id % 10 = 0 AND url NOT LIKE '%/en/%'")).select("page_id", "slug")


@query(f"""WITH s AS (SELECT DISTINCT url, {HOST_SQL} AS host, contains(url, '/en/') AS planned FROM pages)
SELECT t.url AS trigger_url, s.url, CAST(row_number() OVER (PARTITION BY t.url ORDER BY s.url) AS INTEGER) AS rank FROM s t JOIN s ON t.host = s.host AND t.url <> s.url
WHERE t.planned AND NOT s.planned QUALIFY rank <= 5 ORDER BY rank, trigger_url LIMIT 5""")
def sibling_sources(spark, sf_dir):
    """English pages are the planned ones, all others their possible siblings."""
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    planned = urls.where(F.contains("url", F.lit("/en/")))
    return j.siblings(planned, urls.withColumn("tier", F.lit("probation")), planned).select("trigger_url", "url", "rank")


@query("""WITH up AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 4 = 0)
SELECT o_orderkey, o_totalprice FROM up UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM up)""")
def upsert_merge(spark, sf_dir):
    state = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    shifted = state.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    fresh = state.where("o_orderkey % 4 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 10_000_000)
    return tr.upsert(state, shifted.union(fresh).withColumn("arrival", F.col("o_orderkey")), ["o_orderkey"], "arrival")


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'o_totalprice' END, CASE WHEN o_orderkey % 7 = 0 AND o_orderstatus <> 'X' THEN 'o_orderstatus' END) AS changes FROM orders""")
def field_diff(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    new = old.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus"))})
    return tr.changes(old, new, "o_orderkey", ["o_totalprice", "o_orderstatus"]).select("o_orderkey", F.array_join("changes", ",").alias("changes"))


@query("SELECT o_orderkey AS id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey) AS rn FROM orders) WHERE rn > 50")
def top50_cutoff(spark, sf_dir):
    ranked = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return sel.beyond_cut(ranked, [F.desc("o_totalprice"), F.desc("o_custkey"), "id"], 50).select("id")


@query("""WITH q AS (SELECT o_orderkey AS id, o_totalprice AS priority, o_custkey % 3 AS times_run, o_orderdate AS created_at, o_orderkey % 5 <> 0 AS agent FROM orders WHERE o_orderkey % 7 <> 0),
high AS (SELECT id, 1 AS branch FROM q ORDER BY priority DESC, id LIMIT 3), low AS (SELECT id, row_number() OVER (ORDER BY priority, id) AS pos FROM q ORDER BY pos LIMIT 2),
free AS (SELECT id, 2 AS branch FROM low WHERE id NOT IN (SELECT id FROM high) ORDER BY pos LIMIT 1), fresh AS (SELECT id FROM q WHERE times_run = 0 AND agent ORDER BY created_at DESC, id LIMIT 1)
SELECT id, branch FROM high UNION ALL SELECT id, branch FROM free UNION ALL SELECT id, 3 FROM fresh WHERE id NOT IN (SELECT id FROM high UNION ALL SELECT id FROM free)""")
def explore_exploit(spark, sf_dir):
    queries = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("priority"), F.when(F.col("o_orderkey") % 5 != 0, "agent").otherwise("user").alias("created_by"), (F.col("o_custkey") % 3).alias("times_run"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 7 != 0).alias("is_active")
    )
    return sel.explore_exploit(queries, limit=5).select("id", "branch")


@query("""WITH p AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 400 = 0 THEN NULL ELSE o_orderdate END AS last_scraped, o_custkey % 4 - 1 AS found, o_custkey % 5 AS empties FROM orders), pool AS (SELECT * FROM p ORDER BY last_scraped NULLS FIRST, url LIMIT 40)
SELECT url, found, empties FROM pool ORDER BY last_scraped IS NOT NULL, found <= 0, empties, last_scraped NULLS FIRST, url LIMIT 10""")
def productivity_order(spark, sf_dir):
    last = F.when(F.col("o_orderkey") % 400 != 0, F.col("o_orderdate"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("url"), last.alias("last_scraped"), (F.col("o_custkey") % 4 - 1).alias("events_found"), (F.col("o_custkey") % 5).alias("empties"))
    return sel.productivity_order(sources).select("url", F.col("events_found").alias("found"), "empties")


@query("""SELECT o_orderkey, o_custkey % 5 > 0 AND (o_totalprice / 500000 < 0.05 OR (o_custkey % 5 >= 2 AND o_custkey % 3 = 0 AND o_totalprice / 500000 < 0.3)) AS off FROM orders""")
def query_deactivation(spark, sf_dir):
    off = tr.to_deactivate(F.col("o_custkey") % 5, F.col("o_custkey") % 3, F.col("o_totalprice") / 500000)
    return table(spark, sf_dir, "orders").select("o_orderkey", off.alias("off"))


@query("""SELECT source, passed, failed, CASE WHEN passed + failed >= 5 AND passed < (passed + failed) * 0.5 THEN 'demoted' ELSE 'probation' END AS tier FROM (
SELECT source, count(*) FILTER (WHERE good) AS passed, count(*) FILTER (WHERE NOT good) AS failed FROM (SELECT source, CASE WHEN length(source) = 4 THEN quality = 1 ELSE toxic = 1 END AS good FROM labels JOIN documents USING (doc_id)) GROUP BY 1)""")
def validation_demotion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    tally = table(spark, sf_dir, "labels").join(docs, "doc_id").select("source", F.when(F.length("source") == 4, F.col("quality") == 1).otherwise(F.col("toxic") == 1).alias("good"))
    tally = tally.select("source", F.col("good").cast("bigint").alias("passed"), (~F.col("good")).cast("bigint").alias("failed"))
    zero = F.lit(0).cast("bigint")
    sources = tally.select("source").distinct().select("source", F.lit("probation").alias("tier"), zero.alias("passed"), zero.alias("failed"))
    return tr.validated(sources, tally)


@query("""WITH r AS (SELECT user_id AS source, ts, event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS events, CASE WHEN event_type = 'purchase' THEN 'found' WHEN event_type = 'error' THEN 'fetch' WHEN event_type = 'view' OR (event_type = 'click' AND event_id % 2 = 0) THEN 'parse' ELSE 'empty' END AS kind FROM events),
i AS (SELECT *, sum(events) OVER (PARTITION BY source ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island, sum(events) OVER (PARTITION BY source) AS last FROM r)
SELECT source, count(*) FILTER (WHERE island = last AND kind = 'fetch') AS fetch_failures, count(*) FILTER (WHERE island = last AND kind = 'parse') AS parse_failures, count(*) FILTER (WHERE island = last AND kind = 'empty') AS empty_scrapes,
CAST(sum(events) AS BIGINT) AS events_found, count(*) FILTER (WHERE island = last AND kind = 'parse') >= 3 AS escalate, count(*) FILTER (WHERE island = last AND kind = 'empty') >= 3 AND source % 10 <> 0 AS demote FROM i GROUP BY 1""")
def source_state_fold(spark, sf_dir):
    kind = F.col("event_type")
    runs = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("source"), "ts", "event_id", F.when(kind == "purchase", 1).otherwise(0).cast("bigint").alias("events"),
        F.when(kind == "error", "fetch_failed").when(kind == "view", "parse_uncertain").otherwise("success").alias("status"), F.lit(200).alias("http_status"),
        ((kind == "click") & (F.col("event_id") % 2 == 0)).alias("keywords"), (F.col("user_id") % 10 == 0).alias("is_config"),
    )
    return tr.scrape_counters(runs, ["ts", "event_id"])


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT event_id, user_id, rn, true AS accepted, [ts] AS kept FROM o WHERE rn = 1 UNION ALL
SELECT event_id, user_id, rn, len(k) < 3, CASE WHEN len(k) < 3 THEN list_append(k, ts) ELSE k END FROM (SELECT o.*, list_filter(r.kept, lambda x: x > o.ts - INTERVAL 24 HOUR) AS k FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1))
SELECT event_id AS request_id, accepted FROM r""")
def rate_limit(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "user_id", F.col("ts").alias("at"))
    return tr.rate_limited(requests, "user_id")


@query("""SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '5-LOW' THEN 3 ELSE 2 END AS INTEGER) AS severity FROM orders ORDER BY severity, o_orderdate DESC, o_orderkey LIMIT 100""")
def severity_sort(spark, sf_dir):
    rank = sel.severity_rank(F.col("o_orderpriority"), {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2, "5-LOW": 3}, 2)
    return table(spark, sf_dir, "orders").withColumn("severity", rank).orderBy("severity", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "severity")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def ref_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return j.with_parent(orders, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", ["c_name", "c_mktsegment"]).select("o_orderkey", "parent.c_name", "parent.c_mktsegment")


@query("""SELECT user_id AS source, CASE WHEN event_type = 'error' THEN 'parser_error' WHEN n = 0 THEN 'zero_from_expected' END AS trigger FROM (SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS n FROM events) WHERE event_type = 'error' OR n = 0
UNION ALL SELECT user_id, 'high_yield' FROM events WHERE CAST(floor(value / 10) AS BIGINT) >= 10""")
def observer_triggers(spark, sf_dir):
    results = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), (F.col("event_type") == "error").alias("error"), F.floor(F.col("value") / 10).alias("events"), F.lit(True).alias("planned"))
    return tr.observer_triggers(results)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 5 >= 3 THEN 'rolled_back' WHEN o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderpriority = '2-HIGH' THEN 'failed' ELSE 'proposed' END AS status FROM orders""")
def repair_freeze(spark, sf_dir):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "pending").when(F.col("o_orderpriority") == "2-HIGH", "failed").otherwise("proposed")
    frozen = tr.repair_status(status, F.col("o_custkey") % 5, F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", frozen.alias("status"))


@query(f"SELECT page_id, url FROM (SELECT page_id, url, row_number() OVER (PARTITION BY lower({HOST_SQL}) ORDER BY page_id) AS rn FROM pages) WHERE rn <= 2")
def per_host_top2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", host(F.col("url")).alias("host"))
    return sel.top_of_each(pages, ["host"], ["page_id"], 2).select("page_id", "url")


@query("SELECT event_id FROM events WHERE dayofweek(ts) IN (1, 3)")
def schedule_filter(spark, sf_dir):
    days = F.array(F.lit(1), F.lit(3))
    return sel.due(table(spark, sf_dir, "events").withColumn("scrape_days", days), F.col("ts")).select("event_id")

