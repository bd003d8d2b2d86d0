"""Row rules and small joins over the test tables, with values of every class and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions import dates, display, text, urls
from calendrix.operators import lookups
from calendrix.plans.base import registry, table
from calendrix.plans.intake_queries import pick, picked
from calendrix.plans.text_queries import HOST_SQL, PATH_SQL

QUERIES, ORACLES, query = registry()

ASKED = ["https://lu.ma/group/evt", "https://lu.ma/other", "https://site.example/x?y=1", "https://www.sub.site.example/", "not a url", None, "https://meetup.com/Club/events/1", "https://nowhere.example"]
KNOWN = ["https://lu.ma/group/", "https://site.example/", "https://cal.sub.site.example/list", "https://meetup.com/Club", "https://lu.ma/group/evt/deep"]


@query(f"""WITH a AS (SELECT page_id AS id, {picked(ASKED, 'page_id')} AS url FROM pages), s AS (SELECT unnest({picked(KNOWN, '0').rsplit('[CAST', 1)[0]}) AS url),
l AS (SELECT id, {HOST_SQL} AS host, {PATH_SQL} AS path FROM a), r AS (SELECT url AS source_url, {HOST_SQL} AS host, regexp_replace({PATH_SQL}, '/$', '') AS path FROM s)
SELECT DISTINCT id, source_url FROM l JOIN r ON CASE WHEN l.host IN ('lu.ma', 'meetup.com') THEN l.host = r.host AND starts_with(l.path, r.path) ELSE r.host = l.host OR ends_with(r.host, '.' || l.host) END""")
def feedback_matches(spark, sf_dir):
    """Which known sources the submitted pages belong to."""
    asked = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), pick(ASKED, F.col("page_id")).alias("url"))
    return lookups.feedback_sources(asked, spark.createDataFrame([(u,) for u in KNOWN], "url string"))


DONE = ["Created (event_search)", "Skipped (already exists)", "Failed: no", "Created (source_discovery)"]
MADE = ["create_query", "create_source_query", "boost_query"]


@query(f"""WITH a AS (SELECT o_orderkey AS id, {picked(MADE, 'o_orderkey')} AS action, 'q' || (o_custkey % 900) AS text, {picked(DONE, 'o_orderkey // 3')} AS result FROM orders), q AS (SELECT DISTINCT 'q' || c_custkey AS text, c_custkey AS times FROM customer WHERE c_custkey % 3 = 0)
SELECT id, CASE WHEN q.text IS NOT NULL THEN 'active' WHEN starts_with(result, 'Failed') THEN 'failed_to_create' ELSE 'deactivated_or_recycled' END AS status, times FROM a LEFT JOIN q USING (text) WHERE action <> 'boost_query' AND (q.text IS NOT NULL OR NOT starts_with(result, 'Skipped'))""")
def action_outcomes(spark, sf_dir):
    """What became of the queries that past actions made."""
    n = F.col("o_orderkey")
    actions = table(spark, sf_dir, "orders").select(n.alias("id"), pick(MADE, n).alias("action"), F.concat(F.lit("q"), (F.col("o_custkey") % 900).cast("string")).alias("text"), pick(DONE, F.floor(n / 3)).alias("result"))
    queries = table(spark, sf_dir, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("query_text"), (F.col("c_custkey") % 3 == 0).alias("is_active"), F.col("c_custkey").alias("times"))
    return lookups.action_status(actions, queries).select("id", "status", "times")


SHOWN = ["https://WWW.Site.example/Path/X/?q=1#f", "HTTPS://Lu.ma/AITX", "No URL At All", None, "https://site.example:80/a//"]


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 6 = 5 THEN url ELSE {picked(SHOWN, 'page_id % 6')} END AS url FROM pages) SELECT page_id, coalesce({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', ''), lower(url)) AS normal FROM p""")
def feedback_urls(spark, sf_dir):
    """URLs as feedback compares them: the host in lower case, the path as it is."""
    n = F.col("page_id")
    url = F.when(n % 6 == 5, F.col("url")).otherwise(pick(SHOWN, n % 6))
    return table(spark, sf_dir, "pages").select("page_id", urls.normal_url(url, lower=False).alias("normal"))


IDS = ["W2024-x", "evt-1", "W20", "aW2031", None]


@query(f"""SELECT o_orderkey, coalesce(CAST(nullif(regexp_extract({picked(IDS, 'o_orderkey')}, 'W(\\d{{4}})', 1), '') AS INTEGER), CAST(year(o_orderdate) AS INTEGER)) AS event_year, CAST(year(o_orderdate) + CASE WHEN month(o_orderdate) > 2 THEN 1 ELSE 0 END AS INTEGER) AS february_year,
CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M') END AS link_start, CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate + INTERVAL 90 MINUTE + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M') END AS link_end,
CASE WHEN o_orderkey % 3 < 2 THEN strftime(((o_orderdate + INTERVAL 10 HOUR) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%H:%M') END AS local_start FROM orders""")
def date_rules(spark, sf_dir):
    """Years inferred from ids and months, instants of calendar links, and local times that are marked as UTC."""
    n, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss'Z'")
    ten = at + F.expr("INTERVAL 10 HOURS")
    link = F.when(n % 4 != 0, F.concat(F.lit("https://c.example/r?text=x&dates="), stamp(ten), F.lit("/"), stamp(ten + F.expr("INTERVAL 90 MINUTES")))).otherwise("https://c.example/r?text=x")
    marked = F.concat(F.date_format(ten, "yyyy-MM-dd'T'HH:mm:ss"), pick(["Z", "+00:00", " soon"], n))
    shown = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.event_year(pick(IDS, n), at).alias("event_year"), dates.february_year(at).cast("int").alias("february_year"), shown(dates.calendar_link(link)["start"]).alias("link_start"),
        shown(dates.calendar_link(link)["end"]).alias("link_end"), F.date_format(dates.mistagged_local(marked), "HH:mm").alias("local_start"),
    )


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_address WHEN 1 THEN s_address || ', Town ' || s_nationkey || ', TX' WHEN 2 THEN 'Town ' || s_nationkey WHEN 4 THEN '' END AS address FROM (SELECT s_suppkey, s_nationkey, s_name AS s_address FROM supplier)""")
def flat_addresses(spark, sf_dir):
    """Addresses given as strings, as whole objects, as objects with gaps, as empty ones, and as nothing."""
    n, town = F.col("s_suppkey"), F.concat(F.lit("Town "), F.col("s_nationkey").cast("string"))
    whole = F.to_json(F.struct(F.col("s_name").alias("streetAddress"), town.alias("addressLocality"), F.lit("TX").alias("addressRegion")))
    gaps = F.to_json(F.struct(F.lit("").alias("streetAddress"), town.alias("addressLocality")))
    address = F.when(n % 5 == 0, F.col("s_name")).when(n % 5 == 1, whole).when(n % 5 == 2, gaps).when(n % 5 == 3, "{}").otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", dates.flat_address(address).alias("address"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ['a', CAST(o_custkey AS VARCHAR)] WHEN 1 THEN ['bare'] ELSE [] END AS events FROM orders""")
def normalised_results(spark, sf_dir):
    """Events of scrapes that came as a result, as a bare array, or as neither."""
    n, who = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    result = F.when(n % 3 == 0, F.struct(F.array(F.lit("a"), who).alias("events"), F.lit("success").alias("status")))
    bare = F.when(n % 3 == 1, F.array(F.lit("bare")))
    return table(spark, sf_dir, "orders").withColumns({"result": result, "bare": bare}).select("o_orderkey", display.result_events(F.col("result"), F.col("bare")).alias("events"))


PREFIXED = ["Venue: the hall of the town beside the river", "WHEN: tonight at eight in the evening", "short"]


@query(f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split({picked(PREFIXED, 'doc_id')} || chr(10) || coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) >= 30 AND NOT (starts_with(lower(x), 'venue:') OR starts_with(lower(x), 'when:') OR starts_with(lower(x), 'where:') OR starts_with(lower(x), 'date:') OR starts_with(lower(x), 'time:'))) AS kept FROM documents)
SELECT doc_id, least(len(kept), 3) AS paragraphs, md5(array_to_string(kept[:3], chr(10) || chr(10))) AS digest FROM p""")
def harvested_paragraphs(spark, sf_dir):
    """The first three paragraphs of each document that are long enough and no metadata."""
    own = F.concat(pick(PREFIXED, F.col("doc_id")), F.lit("\n"), F.coalesce("text", F.lit("")))
    kept = text.harvested_paragraphs(own)
    n = F.when(kept == "", 0).otherwise(F.size(F.split(kept, "\n\n")))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("bigint").alias("paragraphs"), F.md5(kept).alias("digest"))
