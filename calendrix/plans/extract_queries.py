"""Extraction, source and sink queries. The test pages carry no structured data, so that pages of each
layout are made from their ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions import dates
from calendrix.functions.urls import host
from calendrix.plans.base import events_now, table
from calendrix.operators import lookups
from calendrix.sources import extract, tables
from calendrix.sources import listings as listings_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").withColumn("source", host(F.col("url")))


LD = '<script type="application/ld+json">{"@type":"Event","name":"Ld talk","startDate":"2030-01-01T10:00:00Z","url":"https://a.example/1"}</script>'
NEXT = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"event":{"name":"Next talk","start_at":"2030-01-01T10:00:00Z"}}}}</script>'
CALENDAR = '<script id="__NEXT_DATA__">{"props":{"pageProps":{"x":{"small":[{"name":"only one","url":"one"}],"large":[{"event":{"name":"Array talk","url":"arr-1","start_at":"2030-01-01"},"hosts":[{"name":"Host"}]},{"name":"Array two","slug":"arr-2"},{"name":"no slug"}]}}}}</script>'
CARDS = '<div class="event-card"><h3>Card talk</h3><a href="/c/1">go</a><span class="venue">Hall</span></div><div class="event-card"><h3>Card two</h3><a href="/c/2">go</a></div>'
LINKS = '<a href="https://lu.ma/abc">Link talk one</a><a href="https://lu.ma/about">About us now</a><a href="https://lu.ma/a/b">Too deep</a><a href="https://lu.ma/abc">again here</a><a href="https://luma.com/xyz?k=1">Link two</a>'
LAYOUTS = [LD, NEXT, CALENDAR, CARDS, LINKS, "<p>nothing here</p>"]


def laid_out(spark, sf_dir):
    """The test pages with one of the known layouts each."""
    from calendrix.plans.intake_queries import pick

    return pages(spark, sf_dir).withColumn("html", pick(LAYOUTS, F.col("page_id")))


@query("""SELECT page_id, CASE WHEN page_id % 6 = 5 THEN 'parse_uncertain' ELSE 'success' END AS status, ['json-ld', 'nextdata', 'nextdata', 'css-selectors', 'html-links', NULL][CAST(page_id % 6 AS INTEGER) + 1] AS strategy,
CAST([1, 1, 2, 2, 2, 0][CAST(page_id % 6 AS INTEGER) + 1] AS BIGINT) AS events FROM pages""")
def page_scrape(spark, sf_dir):
    return extract.scrape_results(laid_out(spark, sf_dir)).select("page_id", "status", "strategy", "events")


@query("""SELECT page_id, unnest([['Ld talk'], ['Next talk'], ['Array talk', 'Array two'], ['Card talk', 'Card two'], ['Link talk one', 'Link two'], []][CAST(page_id % 6 AS INTEGER) + 1]) AS title,
unnest([['https://a.example/1'], [NULL], ['https://lu.ma/arr-1', 'https://lu.ma/arr-2'], [NULL, NULL], ['https://lu.ma/abc', 'https://luma.com/xyz?k=1'], []][CAST(page_id % 6 AS INTEGER) + 1]) AS url FROM pages""")
def layout_events(spark, sf_dir):
    """Titles and URLs of each layout; those relative to the page are left out."""
    found = extract.scrape(laid_out(spark, sf_dir), events_now())
    own = F.col("page_id") % 6
    return found.select("page_id", "title", F.when(~own.isin(1, 3), F.col("url")).alias("url"))


FORUM = '<a href="https://www.eventbrite.com/e/t-{0}?aff=x">t</a><a href="/events/april-7-2026">d</a><a href="https://www.eventbrite.com/e/shared">s</a>'


@query("""SELECT DISTINCT link FROM (SELECT 'https://www.eventbrite.com/e/t-' || page_id AS link FROM pages UNION ALL SELECT 'https://www.eventbrite.com/e/shared' UNION ALL SELECT 'https://www.eventbrite.com/e/detail')""")
def ticket_links(spark, sf_dir):
    """Ticket links of listings and of the detail pages that they link to."""
    n = F.col("page_id").cast("string")
    listings = pages(spark, sf_dir).select("page_id", F.lit("https://forum.example/list").alias("url"), F.concat(F.lit(FORUM.split("{0}")[0]), n, F.lit(FORUM.split("{0}")[1])).alias("html"))
    detail = spark.createDataFrame([(-1, "https://forum.example/events/april-7-2026", '<a href="https://www.eventbrite.com/e/detail?x=1">go</a>'), (-2, "https://forum.example/other", '<a href="https://www.eventbrite.com/e/never">no</a>')], "page_id long, url string, html string")
    return listings_.ticket_links(listings, detail)


@query("""SELECT page_id, 'Behind ' || page_id AS title FROM pages WHERE page_id % 4 = 0""")
def listed_pages(spark, sf_dir):
    """URLs of a collection's item list, and the events of the pages behind them."""
    n = F.col("page_id").cast("string")
    own = pages(spark, sf_dir)
    target = F.concat(F.lit("https://x.example/"), n)
    ld = F.concat(F.lit('<script type="application/ld+json">{"@graph":[{"@type":"CollectionPage","mainEntity":{"itemListElement":[{"url":"'), target, F.lit('"}]}},{"@type":"WebSite"}]}</script>'))
    links = listings_.listed_urls(own.where("page_id % 4 = 0").select("page_id", ld.alias("html")))
    event = F.concat(F.lit('<script type="application/ld+json">{"@type":"Event","name":"Behind '), n, F.lit('","startDate":"2030-01-01"}</script>'))
    second = listings_.behind(links, own.select("page_id", target.alias("url"), event.alias("html"), "source"))
    return extract.scrape(second, events_now()).select("page_id", "title")


@query("""SELECT o_orderkey AS id, CAST(unnest([0, 2]) AS INTEGER) AS position, unnest(['Api talk ' || o_orderkey, 'Second']) AS title, unnest(['https://lu.ma/api-' || o_orderkey, 'https://lu.ma/s']) AS url, unnest(['Cal', NULL]) AS organizer FROM orders WHERE o_orderkey % 3 <> 0""")
def api_events(spark, sf_dir):
    n = F.col("o_orderkey").cast("string")
    body = F.concat(F.lit('{"entries":[{"event":{"name":"Api talk '), n, F.lit('","url":"api-'), n, F.lit('"},"calendar":{"name":"Cal"}},{"event":{"name":"","url":"x"}},{"event":{"name":"Second","url":"s"}}]}'))
    responses = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, body).otherwise("no json").alias("body"))
    return listings_.api_events(responses).select("id", "position", "title", "url", "organizer")


@query("""SELECT c_custkey AS query_id, 'https://r.example/' || r AS url, 'T' || r AS title FROM customer, range(0, 20) t(r)""")
def search_input(spark, sf_dir):
    """The first twenty results of search responses of twenty-five."""
    body = '{"organic_results":[' + ",".join(f'{{"link":"https://r.example/{i}","title":"T{i}","snippet":"s"}}' for i in range(25)) + "]}"
    return listings_.search_results(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.lit(body).alias("body"))).drop("snippet")


@query("""SELECT p_partkey AS page_id, CASE p_partkey % 3 WHEN 0 THEN 'AI breakfast' WHEN 1 THEN 'Main hall' END AS title, CASE p_partkey % 3 WHEN 0 THEN '2024-03-05 15:30:00' WHEN 1 THEN '2024-02-25 23:00:00' END AS start, CASE WHEN p_partkey % 3 = 0 THEN 'https://v.example/ai-breakfast' END AS url FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT p_partkey + 1000000, 'Feed ' || p_partkey, NULL, NULL FROM part WHERE p_size % 3 = 0""")
def venue_calendar(spark, sf_dir):
    """Events in the lines of a venue's page, and those of a feed that are at the venue."""
    n = F.col("p_partkey")
    part = table(spark, sf_dir, "part")
    line = F.when(n % 3 == 0, "3/5: AI breakfast, 9:30 am").when(n % 3 == 1, "February 25-27, 2024 | 5 PM | Main hall").otherwise("Join us")
    links = part.select(n.alias("page_id"), F.explode(F.array(F.lit("https://v.example/about"), F.lit("https://v.example/ai-breakfast"))).alias("link"))
    own = listings_.text_line_events(part.select(n.alias("page_id"), line.alias("line")), links, events_now())
    feed = part.select((n + 1_000_000).alias("page_id"), F.concat(F.lit("Feed "), n.cast("string")).alias("title"), F.when(F.col("p_size") % 3 == 0, "The CAPITAL Factory, floor 1").otherwise("Elsewhere").alias("venue_name"), F.lit(None).cast("string").alias("address"))
    at_venue = listings_.venue_feed(feed, "capital factory").select("page_id", "title")
    return own.unionByName(at_venue, allowMissingColumns=True).select("page_id", "title", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start"), "url")


@query("""SELECT p_partkey FROM part WHERE p_partkey % 5 IN (0, 3)""")
def tile_filter(spark, sf_dir):
    from calendrix.plans.intake_queries import pick

    n = F.col("p_partkey")
    title = pick(["Austin AI day", "AI in Berlin", "{{x}}", "A talk on agents", "Houston night"], n)
    cards = table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), F.lit(None).cast("string").alias("venue_name"), F.lit("https://t.example/").alias("url"))
    return listings_.tiles(cards).select("p_partkey")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'detail ' || o_orderkey ELSE 'card' END AS title, CASE WHEN o_custkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'Hall' ELSE 'from card' END AS venue FROM orders""")
def detail_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    listing = orders.select(F.col("o_orderkey").alias("id"), F.lit("card").alias("title"), F.lit("from card").alias("venue"))
    detail = orders.where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("detail "), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_custkey") % 2 == 0, "Hall").alias("venue"))
    return lookups.detail_over_listing(listing, detail, "id", ["title", "venue"])


SERP = ["https://www.meetup.com/g/events/1", "https://allevents.in/x", "https://site.example/events/talk", "https://site.example/blog"]


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Detail title' ELSE 'A long enough title' END AS title FROM customer WHERE c_custkey % 4 IN (0, 2) AND (c_custkey % 3 = 0 OR c_custkey % 3 = 1)""")
def web_search(spark, sf_dir):
    """Results of event pages, with details first; without them a long title and a start are needed."""
    from calendrix.plans.intake_queries import pick

    n = F.col("c_custkey")
    link = F.concat(pick(SERP, n), F.lit("#"), n.cast("string"))
    own = table(spark, sf_dir, "customer").select(n.alias("id"), link.alias("link"), F.when(n % 3 == 1, "A long enough title").otherwise("Short").alias("title"), F.when(n % 3 == 1, "2030-01-01").alias("start_time"), F.lit(None).cast("string").alias("venue_name"))
    details = own.where("id % 3 = 0").select(F.col("link").alias("url"), F.lit("Detail title").alias("title"), F.lit("2030-01-02").alias("start_time"), F.lit("V").alias("venue_name"), F.lit(0).alias("position"))
    found = extract.search_events(own.drop("id"), details)
    return found.select(F.split_part("link", F.lit("#"), F.lit(-1)).cast("bigint").alias("id"), "title")


@query("""SELECT 'a' AS kind, count(*) AS n FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE 'promo%' UNION ALL SELECT 'b', count(*) FROM part WHERE p_name LIKE '%ring' AND p_brand NOT IN ('Brand#2', 'Brand#8') AND nullif(p_type, 'PROMO') IS NULL""")
def text_predicates(spark, sf_dir):
    """like, ilike, their disjunction, not in, and is null."""
    part = table(spark, sf_dir, "part")
    either = part.where(F.col("p_name").ilike("%RING%") | F.col("p_type").ilike("promo%"))
    other = part.where(F.col("p_name").like("%ring") & ~F.col("p_brand").isin("Brand#2", "Brand#8") & F.nullif(F.col("p_type"), F.lit("PROMO")).isNull())
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(either, "a").union(count(other, "b"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def single_row(spark, sf_dir):
    return tables.one(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", 77)


@query("SELECT count(*) AS upcoming FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND event_type <> 'error'")
def upcoming_view(spark, sf_dir):
    """The view of upcoming live events, read by SQL."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start_time"), F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))
    tables.upcoming_events(rows, F.lit("2024-01-20").cast("timestamp")).createOrReplaceTempView("upcoming_events")
    return spark.sql("SELECT count(*) AS upcoming FROM upcoming_events")


@query("""SELECT title, strftime(TIMESTAMP '2024-01-31' + to_days(days) + to_hours(hour), '%Y-%m-%d %H:%M') AS start, source FROM (VALUES ('Kick-off', 7, 18, 'luma'), ('Workshop', 14, 9, 'meetup'), ('Past talk', -3, 12, 'manual')) v(title, days, hour, source)""")
def seed_rows(spark, sf_dir):
    made = tables.seed(spark, events_now(), [("Kick-off", 7, 18, "luma"), ("Workshop", 14, 9, "meetup"), ("Past talk", -3, 12, "manual")])
    return made.select("title", F.date_format("start_time", "yyyy-MM-dd HH:mm").alias("start"), "source")


@query("""SELECT page_id, 'Event ' || page_id AS title, 'https://a.example/e/' || (page_id % 40) AS url, CASE WHEN page_id % 2 = 0 THEN 'Hall & Bar' END AS venue_name FROM pages WHERE page_id % 3 <> 0""")
def json_ld_scrape(spark, sf_dir):
    """The test pages with a JSON-LD event each, a third of them over."""
    n = F.col("page_id").cast("string")
    start = F.when(F.col("page_id") % 3 == 0, "2023-05-01T10:00:00Z").otherwise("2024-03-01T10:00:00Z")
    place = F.when(F.col("page_id") % 2 == 0, F.lit(', "location": {"name": "Hall & Bar"}')).otherwise("")
    ld = F.concat(F.lit('<script type="application/ld+json">{"@type": "MusicEvent", "name": "Event '), n, F.lit('", "url": "https://a.example/e/'), (F.col("page_id") % 40).cast("string"), F.lit('", "startDate": "'), start, F.lit('"'), place, F.lit("}</script>"))
    made = pages(spark, sf_dir).withColumn("html", F.concat(ld, F.col("html")))
    return extract.scrape(made, events_now()).select("page_id", "title", "url", "venue_name")


@query("""SELECT o_orderkey, strftime(((o_orderdate + INTERVAL 17 HOUR + INTERVAL 30 MINUTE) AT TIME ZONE 'America/Chicago') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS start FROM orders""")
def local_time_parse(spark, sf_dir):
    said = F.concat(F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" | 5:30 PM | Main hall"))
    start = dates.month_day_line(said, events_now())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start"))


ISO = "strftime((({0}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%dT%H:%M:%S') || CASE WHEN {0} >= TIMESTAMP '2024-03-10 08:00:00' AND {0} < TIMESTAMP '2024-11-03 07:00:00' THEN '-05:00' ELSE '-06:00' END"


@query(f"""SELECT event_id AS id, row_number() OVER (ORDER BY s, event_id) AS position, {ISO.format('s')} AS "start", CASE WHEN event_id % 4 > 0 THEN {ISO.format('e')} END AS "end", CASE WHEN event_id % 3 = 0 THEN 'Hall' WHEN event_id % 3 = 1 THEN '1 Main St' ELSE 'Austin, TX' END AS place,
CASE WHEN event_id % 3 = 1 THEN '1 Main St' ELSE 'Austin, TX' END AS address, CASE WHEN event_id % 5 = 0 THEN 'Org' END AS organizer, CASE event_id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS free FROM (SELECT event_id, ts + to_days(CAST(event_id % 120 AS INTEGER)) AS s, ts + to_days(CAST(event_id % 120 AS INTEGER)) + INTERVAL 40 DAY AS e FROM events)""")
def jsonld_export(spark, sf_dir):
    """Every event as an item with its position; each date has the offset of its own day."""
    n = F.col("event_id")
    start = F.col("ts") + F.make_dt_interval((n % 120).cast("int"))
    rows = table(spark, sf_dir, "events").select(
        n.alias("id"), n.cast("string").alias("title"), start.alias("start_time"), F.when(n % 4 > 0, start + F.expr("INTERVAL 40 DAYS")).alias("end_time"), F.when(n % 3 == 0, "Hall").otherwise("").alias("venue_name"),
        F.lit(None).cast("string").alias("location"), F.when(n % 3 == 1, "1 Main St").alias("address"), F.lit("https://a.example/").alias("url"), F.col("props").alias("description"), F.when(n % 5 == 0, "Org").alias("organizer"),
        F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("is_free"),
    )
    field = lambda path: F.get_json_object("item", path)
    return tables.json_ld_items(rows, "America/Chicago", "Austin, TX").select(
        field("$.name").cast("bigint").alias("id"), F.col("position").cast("bigint").alias("position"), field("$.startDate").alias("start"), field("$.endDate").alias("end"), field("$.location.name").alias("place"),
        field("$.location.address").alias("address"), field("$.organizer.name").alias("organizer"), field("$.isAccessibleForFree").alias("free"),
    )


@query("""SELECT 'daily' AS run_type, CAST(90 AS BIGINT) AS run_duration_seconds, count(*) FILTER (WHERE event_type = 'view') AS queries_run, count(*) FILTER (WHERE event_type = 'purchase') AS events_added, count(*) FILTER (WHERE event_type = 'error') AS errors,
CAST(sum(user_id % 5) AS BIGINT) AS events_discovered, count(*) FILTER (WHERE event_type = 'error') AS messages, array_to_string(list('e' || (event_id % 4) ORDER BY event_id) FILTER (WHERE event_type = 'error'), ',') AS in_order, count(*) FILTER (WHERE event_type = 'click' AND user_id % 2 = 0) AS feedback_analyzed, count(DISTINCT user_id) AS sources, count(*) FILTER (WHERE event_type = 'click') AS duplicates FROM events""")
def run_log(spark, sf_dir):
    kind, n = F.col("event_type"), F.col("event_id")
    zero = F.lit(0).cast("bigint")
    one = lambda k: (kind == k).cast("bigint")
    known = {"queries_run": one("view"), "events_added": one("purchase"), "errors": one("error"), "events_discovered": F.col("user_id") % 5, "feedback_analyzed": ((kind == "click") & (F.col("user_id") % 2 == 0)).cast("bigint")}
    steps = table(spark, sf_dir, "events").select(
        n.alias("pos"), *[known.get(c, zero).alias(c) for c in tables.RUN_COUNTERS], F.when(kind == "error", F.concat(F.lit("e"), (n % 4).cast("string"))).alias("error"), F.col("user_id").alias("source"),
        F.when(kind == "click", "duplicate").when(kind == "purchase", "accepted").alias("outcome"), (F.col("user_id") % 5).alias("events"),
    )
    row = tables.run_log(steps, "daily", F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:01:29.6").cast("timestamp"))
    return row.select("run_type", "run_duration_seconds", "queries_run", "events_added", "errors", "events_discovered", F.size("error_messages").cast("bigint").alias("messages"), F.array_join("error_messages", ",").alias("in_order"), "feedback_analyzed", F.size("source_results").cast("bigint").alias("sources"), F.col("decision_summary")["duplicate"].alias("duplicates"))
