"""Intake and display queries over the test tables, with their DuckDB twins.

Texts and URLs that the test tables do not hold are made from their keys, so that every branch of a
rule has rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions import display as v
from calendrix.functions import semantics as s
from calendrix.functions import text as t
from calendrix.functions import urls as u
from calendrix.operators import intake as i
from calendrix.operators import selection as sel
from calendrix.plans.base import events_now, registry, table
from calendrix.plans.text_queries import HOST_SQL, PATH_SQL, _any, _quoted

QUERIES, ORACLES, query = registry()


def pick(values, n, kind: str = "string"):
    """One of the values by a number column."""
    return F.get(F.array(*[F.lit(x).cast(kind) for x in values]), (n % len(values)).cast("int"))


def picked(values, n: str) -> str:
    """pick() in SQL; values are quoted, None is null."""
    listed = ", ".join("NULL" if x is None else str(x) if isinstance(x, (int, float, bool)) else "'" + x.replace("'", "''") + "'" for x in values)
    return f"[{listed}][CAST(({n}) % {len(values)} AS INTEGER) + 1]"


TITLES = ["AI builders night", "tbd", "Demo", "<div class=x>", "Data talk in Houston", "", None, ".card-x { color }", "Agents & tools meetup"]
VENUES = ["Capital Factory", "Zoom only", "", None, "Somewhere hall", "Austin Central Library"]
TIERS = ["config", "probation", None]
IDS = "event_id AS id"
TITLE_SQL, VENUE_SQL, TIER_SQL = picked(TITLES, "event_id"), picked(VENUES, "event_id // 9"), picked(TIERS, "event_id // 54")


def arrivals(spark, sf_dir):
    """events as scraped ones, whose titles, venues and tiers take turns."""
    n = F.col("event_id")
    turn = lambda d: F.floor(n / d)
    end = F.when(n % 4 == 0, F.col("ts")).when(n % 4 == 1, F.col("ts") - F.expr("INTERVAL 1 HOUR")).when(n % 4 == 2, F.col("ts") + F.expr("INTERVAL 2 HOURS"))
    return table(spark, sf_dir, "events").select(
        n.alias("id"), pick(TITLES, n).alias("title"), F.when(n % 11 != 0, F.concat(F.lit("https://a.example/"), n.cast("string"))).alias("url"), pick(TIERS, turn(54)).alias("tier"),
        F.when(n % 7 != 0, F.col("ts")).alias("start_time"), end.alias("end_time"), pick(VENUES, turn(9)).alias("venue"), F.lit(None).cast("string").alias("address"),
        F.lit("").alias("location"), F.when(n % 3 == 0, F.col("props")).alias("description"), F.when(n % 5 == 0, F.lit(True)).alias("is_free"), (F.col("user_id") % 7).alias("source"),
    )


def said(spark, sf_dir):
    """Verdicts on all but every thirteenth event."""
    n = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_id % 13 <> 0").select(
        n.alias("id"), (n % 4 != 1).alias("valid"), pick([0.55, 0.6, 0.79, 0.81, 0.95], n, "double").alias("confidence"), F.lit("off topic").alias("reason"),
        F.when(n % 2 == 0, F.lit("short")).otherwise(F.lit("")).alias("summary"), (n % 3 == 0).alias("is_free"),
    )


DECIDED = f"""WITH e AS (SELECT {IDS}, {TITLE_SQL} AS title, CASE WHEN event_id % 11 <> 0 THEN 'https://a.example/' || event_id END AS url, {TIER_SQL} AS tier,
 CASE WHEN event_id % 7 <> 0 THEN ts END AS start_time, CASE event_id % 4 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 1 HOUR WHEN 2 THEN ts + INTERVAL 2 HOUR END AS end_time, {VENUE_SQL} AS venue,
 CASE WHEN event_id % 3 = 0 THEN props END AS description, CASE WHEN event_id % 5 = 0 THEN true END AS is_free, user_id % 7 AS source,
 event_id % 13 <> 0 AS known, event_id % 4 <> 1 AS valid, {picked([0.55, 0.6, 0.79, 0.81, 0.95], 'event_id')} AS confidence, CASE WHEN event_id % 2 = 0 THEN 'short' END AS summary, event_id % 3 = 0 AS free FROM events),
p AS (SELECT *, lower(concat_ws(' ', nullif(title, ''), nullif(venue, ''))) AS spot, trim(title) AS clean FROM e),
q AS (SELECT *, list_filter({_quoted(t.OUTSIDE_CITIES)}, lambda w: contains(spot, w))[1] AS city, length(spot) >= 4 AND len(list_filter({_quoted(t.LOCAL_TERMS)}, lambda w: contains(spot, w))) > 0 AS here FROM p),
r AS (SELECT *, CASE WHEN city IS NOT NULL THEN false WHEN here THEN true END AS is_local,
 CASE WHEN coalesce(title, '') = '' OR url IS NULL THEN 'missing title or url' WHEN length(clean) < 5 OR list_contains({_quoted(t.PLACEHOLDER_TITLES)}, lower(clean)) THEN 'invalid or placeholder title'
  WHEN {_any('clean', t.MALFORMED_TITLE_PATTERNS)} OR length(regexp_replace(clean, '[^a-zA-Z0-9]', '', 'g')) < length(clean) * 0.3 THEN 'malformed title' END AS dropped FROM q),
d AS (SELECT *, CASE WHEN tier = 'config' AND is_local THEN 'accept' WHEN tier = 'config' AND NOT is_local THEN 'reject' ELSE 'model' END AS route FROM r),
f AS (SELECT *, route = 'accept' OR (route = 'model' AND coalesce(known AND valid AND confidence >= 0.6, false)) AS good FROM d),
decided AS (SELECT *, CASE WHEN dropped IS NOT NULL THEN 'pre_filter' WHEN route = 'reject' THEN 'location_check' WHEN NOT good THEN 'validation' WHEN start_time IS NULL THEN 'pre_filter' ELSE 'upsert' END AS stage,
 CASE WHEN dropped IS NOT NULL THEN 'skipped' WHEN route = 'reject' OR NOT good THEN 'rejected' WHEN start_time IS NULL THEN 'skipped' ELSE 'accepted' END AS outcome,
 CASE WHEN dropped IS NOT NULL THEN dropped WHEN route = 'reject' THEN 'outside: ' || city WHEN NOT good THEN CASE WHEN known THEN 'off topic' ELSE 'no verdict' END WHEN start_time IS NULL THEN 'no start time' END AS decision_reason FROM f) """


@query(DECIDED + """SELECT id, stage, outcome, decision_reason, route, coalesce(CASE WHEN route = 'accept' THEN true WHEN route = 'reject' THEN true ELSE known AND confidence > 0.8 END, false) AS is_verified,
end_time > start_time AS ends, coalesce(CASE WHEN known THEN summary END, nullif(description, '')) AS description, CAST(coalesce(is_free, CASE WHEN known THEN free END) AS VARCHAR) AS is_free FROM decided""".replace("end_time > start_time AS ends", "coalesce(end_time > start_time, false) AS ends"))
def event_intake(spark, sf_dir):
    """Pre-filters, location routing, validation gate and the fields that are stored."""
    made = i.decided(arrivals(spark, sf_dir), said(spark, sf_dir))
    return made.select("id", "stage", "outcome", "decision_reason", "route", "is_verified", F.col("end_time").isNotNull().alias("ends"), "description", F.col("is_free").cast("string").alias("is_free"))


@query(DECIDED + """SELECT source, count(*) FILTER (WHERE stage = 'upsert' OR decision_reason = 'no start time') AS passed, count(*) FILTER (WHERE stage = 'validation' AND outcome = 'rejected') AS failed FROM decided
WHERE coalesce(tier, '') <> 'config' AND decision_reason IS DISTINCT FROM 'missing title or url' AND stage <> 'location_check' GROUP BY 1""")
def intake_tally(spark, sf_dir):
    return i.intake_tally(i.decided(arrivals(spark, sf_dir), said(spark, sf_dir)))


@query(DECIDED + """SELECT count(*) AS events_discovered, count(*) FILTER (WHERE stage = 'upsert' OR decision_reason = 'no start time') AS events_validated, count(*) FILTER (WHERE outcome = 'accepted') AS events_added,
count(*) FILTER (WHERE outcome = 'skipped') AS events_skipped, count(*) FILTER (WHERE outcome = 'rejected' AND stage = 'location_check') AS rejected_by_place, count(*) FILTER (WHERE outcome = 'rejected' AND stage = 'validation') AS rejected_by_verdict,
count(*) FILTER (WHERE (stage <> 'pre_filter' OR decision_reason = 'no start time') AND route = 'model') AS model_calls FROM decided""")
def intake_counters(spark, sf_dir):
    return i.run_counters(i.decided(arrivals(spark, sf_dir), said(spark, sf_dir)))


@query("""SELECT page_id, coalesce(page_id % 3 = 0 AND page_id % 5 < 3 AND page_id % 4 <> 1 AND length(html) * (page_id % 3 + 1) > 5000 AND page_id % 7 <> 0 AND page_id % 6 >= 1, false) AS verify FROM pages""")
def content_verification(spark, sf_dir):
    n = F.col("page_id")
    verify = i.needs_verification(n % 3, n % 5 < 3, F.when(n % 4 == 1, 404).otherwise(200), F.length("html") * (n % 3 + 1), n % 7 != 0, F.lit("text"), n % 6)
    return table(spark, sf_dir, "pages").select("page_id", verify.alias("verify"))


@query("""SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 AND doc_id % 4 <> 0 AND doc_id % 10 >= 7 THEN 'trusted' WHEN quality = 1 AND toxic = 0 AND doc_id % 4 <> 0 AND doc_id % 10 >= 5 THEN 'review' END AS taken FROM labels""")
def source_acceptance(spark, sf_dir):
    taken = i.source_acceptance(F.col("quality") == 1, F.col("toxic") == 0, F.col("doc_id") % 4 != 0, (F.col("doc_id") % 10) / 10)
    return table(spark, sf_dir, "labels").select("doc_id", taken.alias("taken"))


@query("""SELECT o_orderkey, o_orderkey % 9 = 0 OR CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate + INTERVAL (o_orderkey % 12) SECOND END >= o_orderdate + INTERVAL 10 SECOND - INTERVAL 5 SECOND AS fresh FROM orders""")
def upsert_freshness(spark, sf_dir):
    at = F.col("o_orderdate")
    created = F.when(F.col("o_orderkey") % 9 != 0, at + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("o_orderkey") % 12))
    return table(spark, sf_dir, "orders").select("o_orderkey", i.is_fresh(created, at + F.expr("INTERVAL 10 SECONDS")).alias("fresh"))


IMAGE_CITIES, IMAGE_ADDRESSES = ["Austin", "", None], [None, "1 Main St", ""]


@query(f"""SELECT p_partkey, CASE WHEN bare THEN nullif(found_venue, '') ELSE venue END AS venue,
CASE WHEN bare THEN CASE WHEN coalesce(city, '') <> '' THEN coalesce(nullif(found_address, ''), concat_ws(', ', city, nullif(state, ''))) END ELSE address END AS address
FROM (SELECT p_partkey, venue, address, coalesce(nullif(venue, ''), nullif(address, '')) IS NULL AS bare, {picked(['Hall', '', None, 'Loft'], 'p_partkey // 4')} AS found_venue, {picked(IMAGE_CITIES, 'p_partkey')} AS city,
 {picked(IMAGE_ADDRESSES, 'p_partkey // 3')} AS found_address, {picked(['TX', ''], 'p_partkey')} AS state FROM (SELECT p_partkey, {picked(['', None, 'Own hall'], 'p_size')} AS venue, {picked([None, '', '', '9 Side St'], 'p_size')} AS address, p_size FROM part))""")
def image_location(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    found = F.struct(pick(["Hall", "", None, "Loft"], F.floor(n / 4)).alias("venue"), pick(IMAGE_CITIES, n).alias("city"), pick(IMAGE_ADDRESSES, F.floor(n / 3)).alias("address"), pick(["TX", ""], n).alias("state"))
    place = i.image_place(pick(["", None, "Own hall"], size), pick([None, "", "", "9 Side St"], size), found)
    return table(spark, sf_dir, "part").select("p_partkey", place.alias("p")).select("p_partkey", "p.venue", "p.address")


URLS = [
    "https://www.meetup.com/group-x/events/12345/", "https://meetup.com/find/?keywords=ai", "https://lu.ma/austin-ai", "https://www.eventbrite.com/e/some-event-name-and-number-1", "https://luma.com/discover/",
    "https://x.example/events/2024-03-01/", "https://x.example/events/month/2023-05/", "https://www.linkedin.com/events/9", "https://allevents.in/austin/event/1", "https://news.x.example/page/3/",
    "https://sub.lu.ma/y?page=2", "https://x.example/events/?eventDisplay=past", "not a url", "https://x.example/explore", "https://x.example/event?id=7", "https://x.example/about",
]
URL_ROWS = f"(SELECT page_id, {picked(URLS, 'page_id')} AS url FROM pages)"


def made_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pick(URLS, F.col("page_id")).alias("url"))


@query(f"""SELECT page_id, {_any('url', u.SINGLE_EVENT)} AS single_event, {_any('url', u.BROAD_SEARCH)} AS broad_search, len(list_filter({_quoted(u.SKIPPED_HOSTS)}, lambda h: contains(lower(url), h))) > 0 AS skipped,
NOT contains(url, 'allevents.in') AND (contains(url, 'meetup.com/') OR contains(url, 'eventbrite.com/e/') OR contains(url, 'lu.ma/') OR regexp_matches(url, '/events?/[^/?]')) AS event_page,
contains(lower(url), 'eventdisplay=past') OR contains(lower(url), 'tribe-bar-date=') OR {_any('url', u.PAGED_OR_PAST)} AS paged,
coalesce(len(list_filter({_quoted(u.PLATFORMS)}, lambda d: {HOST_SQL} = d OR ends_with({HOST_SQL}, '.' || d))) > 0, false) AS platform,
CASE {HOST_SQL} WHEN 'lu.ma' THEN 'luma' WHEN 'luma.com' THEN 'luma' WHEN 'meetup.com' THEN 'meetup' END AS parser, coalesce(lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')), lower(url)) AS normal FROM {URL_ROWS}""")
def url_class_variants(spark, sf_dir):
    """Every URL class with rows of both kinds."""
    url = F.col("url")
    classes = {"single_event": u.single_event(url), "broad_search": u.broad_search(url), "skipped": u.skipped_host(url), "event_page": u.event_page(url), "paged": u.paged_or_past(url), "platform": u.shared_platform(url)}
    return made_urls(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in classes.items()], u.parser_for(url).alias("parser"), u.normal_url(url).alias("normal"))


TEXTS = ["Plain words that say enough", "@media screen", "{{x}}", "..--..--!!", "ab", "const a = 1", "margin: 12px", "#main { x }", "A talk (at 7) & more", None, "<b>bold</b>", "font-size: 3"]


@query(f"""SELECT p_partkey, coalesce(text = '' OR {_any('text', t.MALFORMED_TITLE_PATTERNS)} OR length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) < length(text) * 0.3, true) AS malformed,
coalesce(length(text) < 3 OR {_any('text', t.GARBAGE_PATTERNS)} OR length(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')) < length(text) * 0.4, true) AS garbage FROM (SELECT p_partkey, {picked(TEXTS, 'p_partkey')} AS text FROM part)""".replace("\\\\s", "\\s"))
def title_quality_variants(spark, sf_dir):
    text = pick(TEXTS, F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", t.malformed_title(text).alias("malformed"), t.garbage_text(text).alias("garbage"))


HTML_PARTS = ['<script type="application/ld+json">{}</script>', '<script id="__NEXT_DATA__">{}</script>', "Please RSVP by May 5", "on 3/4/2024", "nothing"]


@query(f"""SELECT page_id, contains(h, 'application/ld+json') AS has_json_ld, contains(h, '__next_data__') AS has_next_data, regexp_matches(h, '\\b(register|rsvp|attend|event|meetup|join us|upcoming)\\b') AS has_event_keywords,
regexp_matches(h, '\\b(january|february|march|april|may|june|july|august|september|october|november|december)\\s+[0-9]{{1,2}}') OR regexp_matches(h, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}') AS has_date_patterns, page_size, status
FROM (SELECT page_id, lower({picked(HTML_PARTS, 'page_id')}) AS h, CAST(length({picked(HTML_PARTS, 'page_id')}) AS INTEGER) AS page_size, CAST({picked([200, 404, None], 'page_id')} AS INTEGER) AS status FROM pages)""")
def fetch_diagnostics(spark, sf_dir):
    diagnostics = v.fetch_diagnostics(pick([200, 404, None], F.col("page_id"), "int"), pick(HTML_PARTS, F.col("page_id")), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", diagnostics.alias("d")).select("page_id", "d.signals.*", "d.page_size", F.col("d.http_status").alias("status"))


@query(f"""SELECT p_partkey, CASE WHEN contains(lower(title), 'houston') OR contains(lower(title), 'dallas') OR contains(lower(title), 'san antonio') OR coalesce(contains(lower(venue), 'houston'), false) THEN true ELSE false END AS elsewhere,
CASE WHEN city IS NOT NULL THEN 'false' WHEN len(list_filter({_quoted(t.LISTING_LOCAL_TERMS)}, lambda w: contains(spot, w))) > 0 THEN 'true' END AS listed
FROM (SELECT *, lower(concat_ws(' ', title, venue)) AS spot, list_filter({_quoted(t.LISTING_OUTSIDE_CITIES)}, lambda w: contains(lower(concat_ws(' ', title, venue)), w))[1] AS city FROM (SELECT p_partkey, {picked(['AI day', 'Dallas summit', 'SXSW talk', 'Berlin demo'], 'p_partkey')} AS title, {picked(['Hall', None, 'Houston hub', 'Austin hub', 'Room'], 'p_partkey')} AS venue FROM part))""")
def city_filters(spark, sf_dir):
    title, venue = pick(["AI day", "Dallas summit", "SXSW talk", "Berlin demo"], F.col("p_partkey")), pick(["Hall", None, "Houston hub", "Austin hub", "Room"], F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", t.elsewhere(title, venue).alias("elsewhere"), t.listing_location(title, venue).cast("string").alias("listed"))


@query(f"""SELECT page_id, CASE WHEN place LIKE '%.style-%' OR place LIKE '%position:%' OR place LIKE '%display:%' OR place LIKE '%font-size:%' THEN NULL ELSE place END AS place FROM (SELECT page_id, {picked(['.style-a { }', 'Hall', 'a { position: fixed }', None, 'display: none', '', 'font-size: 2'], 'page_id')} AS place FROM pages)""")
def style_cleanup(spark, sf_dir):
    place = pick([".style-a { }", "Hall", "a { position: fixed }", None, "display: none", "", "font-size: 2"], F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", v.without_styles(place).alias("place"))


@query("""SELECT c_custkey, list_distinct(p) IS NOT NULL AND len(p) > 0 AS any_part, array_to_string(list_filter([CASE WHEN venue <> '' THEN venue END, CASE WHEN address <> '' AND address <> coalesce(venue, '') THEN address END, 'Austin'], lambda x: x IS NOT NULL), ', ') AS address
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN '' END AS venue, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS address, ['Austin'] AS p FROM customer)""")
def full_address(spark, sf_dir):
    n = F.col("c_custkey")
    venue = F.when(n % 3 == 0, F.col("c_name")).when(n % 3 == 1, "")
    address = v.full_address(venue, F.when(n % 2 == 0, F.col("c_name")).otherwise(F.col("c_mktsegment")), F.lit("Austin"))
    return table(spark, sf_dir, "customer").select("c_custkey", address.isNotNull().alias("any_part"), address.alias("address"))


@query("""SELECT event_id, strftime(l, '%b') AS month, strftime(l, '%-d') AS day, strftime(l, '%a') AS weekday, strftime(l, '%-I:%M %p') AS clock, strftime(l, '%A, %B %-d, %Y') AS "full" FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS l FROM events)""")
def display_dates(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", v.date_parts(F.col("ts"), "America/Chicago").alias("d")).select("event_id", "d.*")


AGENTS = ["Mozilla/5.0 (iPhone; CPU)", "Mozilla/5.0 (Linux; Android 14)", "Mozilla/5.0 (X11)", None]


@query(f"""SELECT c_custkey, device, CASE device WHEN 'android' THEN 'geo:0,0?q=' WHEN 'ios' THEN 'https://maps.apple.com/?q=' ELSE 'https://www.google.com/maps/search/?api=1&query=' END || replace(replace(place, ' ', '%20'), '#', '%23') AS link
FROM (SELECT c_custkey, c_name || ' Austin' AS place, CASE WHEN contains(lower(a), 'iphone') THEN 'ios' WHEN contains(lower(a), 'android') THEN 'android' ELSE 'desktop' END AS device FROM (SELECT *, {picked(AGENTS, 'c_custkey')} AS a FROM customer))""")
def map_links(spark, sf_dir):
    kind = v.device(pick(AGENTS, F.col("c_custkey")))
    return table(spark, sf_dir, "customer").select("c_custkey", kind.alias("device"), v.map_link(F.concat("c_name", F.lit(" Austin")), kind).alias("link"))


@query("""SELECT c_custkey, CASE WHEN score IS NULL THEN 'Unknown' WHEN score >= 0.8 THEN 'High' WHEN score >= 0.6 THEN 'Medium' ELSE 'Low' END AS label, CAST(CAST(floor(score * 100 + 0.5) AS INTEGER) AS VARCHAR) AS percent,
CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE CASE WHEN c_custkey % 2 = 0 THEN 'site.example' ELSE 'no url' END END AS name, CASE WHEN c_custkey % 10 > 6 THEN 'over' WHEN c_custkey % 10 < 2 THEN 'under' ELSE 'within' END AS direction,
CASE c_custkey % 4 WHEN 0 THEN 'meetup' WHEN 1 THEN 'luma' ELSE 'scrape' END AS scraper, CASE WHEN c_custkey % 200 > 0 THEN CAST(floor((c_custkey % 200) / 60::DOUBLE + 0.5) AS INTEGER) END AS minutes, substring(c_name, 1, 12) AS short
FROM (SELECT *, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 11) / 11::DOUBLE END AS score FROM customer)""")
def source_cards(spark, sf_dir):
    n = F.col("c_custkey")
    badge = v.trust_badge(F.when(n % 5 != 0, (n % 11) / 11))
    name = v.source_name(F.when(n % 3 == 0, F.col("c_name")).otherwise(""), F.when(n % 2 == 0, "https://www.site.example/a").otherwise("no url"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", badge["label"].alias("label"), badge["percent"].alias("percent"), name.alias("name"), v.direction(n % 10, F.lit(4)).alias("direction"),
        v.scraper_for(pick(["meetup", "luma", "eventbrite", None], n)).alias("scraper"), v.minutes_of(n % 200).alias("minutes"), v.shortened(F.col("c_name"), 12).alias("short"),
    )


VENUE_TEXTS = ["Intro\nVenue: Capital Factory, 701 Brazos St, Austin\nRoom 1", "Come to our location: The Loft, 2 Side St", "no place given", "Venue: Alone", None]
VENUE_WANT = [("Capital Factory", "701 Brazos St, Austin"), ("The Loft", "2 Side St"), (None, None), ("Alone", None), (None, None)]


@query(f"SELECT p_partkey, {picked([a for a, _ in VENUE_WANT], 'p_partkey')} AS venue, {picked([b for _, b in VENUE_WANT], 'p_partkey')} AS address FROM part")
def venue_lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", v.venue_line(pick(VENUE_TEXTS, F.col("p_partkey"))).alias("x")).select("p_partkey", "x.venue", "x.address")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) % 3 AS events, CASE WHEN l_linenumber % 2 = 0 THEN 'parse_uncertain' ELSE 'success' END AS scrape_status,
array_to_string([CASE WHEN l_linenumber = 1 THEN 'e1' WHEN l_linenumber = 2 THEN 'm2' ELSE 'Unknown error' END, 'second', 'third'], '|') AS errors FROM lineitem""")
def source_results(spark, sf_dir):
    """A scrape's row in the run log, and its first three error messages."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("string")
    made = v.source_result(F.lit("s"), F.lit("u"), F.col("l_quantity").cast("int") % 3, F.when(n % 2 == 0, "parse_uncertain"), F.lit("luma"), none)
    error = lambda e, m: F.struct(e.cast("string").alias("error"), m.cast("string").alias("message"))
    first = error(F.when(n == 1, "e1"), F.when(n <= 2, "m2").otherwise(""))
    errors = v.first_errors(F.array(first, error(F.lit("second"), none), error(none, F.lit("third")), error(F.lit("fourth"), none)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made["events"].alias("events"), made["scrape_status"].alias("scrape_status"), F.array_join(errors, "|").alias("errors"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_size % 2 = 0 ELSE p_size % 3 = 0 OR p_size % 5 = 1 END AS free FROM part""")
def free_inference(spark, sf_dir):
    n, size = F.col("p_partkey"), F.col("p_size")
    accessible = F.when(n % 4 == 0, size % 2 == 0)
    free = t.is_free(F.when(size % 3 == 0, 0).when(size % 5 != 1, 15), accessible, F.when(size % 5 == 1, "Free entry").otherwise("$15"))
    return table(spark, sf_dir, "part").select("p_partkey", free.alias("free"))


@query("SELECT event_id FROM events WHERE user_id % 3 IN (0, 2) AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' AND event_type <> 'error'")
def facet_spec(spark, sf_dir):
    """Sources and a date range beside the facets, and live rows only."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).cast("string").alias("source"), F.col("ts").alias("start_time"), F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted_at"))
    first, last = (F.lit(x).cast("timestamp") for x in ("2024-01-05", "2024-01-20"))
    return sel.faceted(sel.live(rows), None, None, sources=["0", "2"], first=first, last=last).select("event_id")


@query("SELECT event_id, strftime(CASE WHEN event_id % 4 = 0 THEN date_trunc('day', ts) ELSE ts END, '%H:%M:%S') = '00:00:00' AS placeholder FROM events")
def placeholder_midnight(spark, sf_dir):
    at = F.when(F.col("event_id") % 4 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", s.midnight(at).alias("placeholder"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-11' AND event_id % 6 <> 0")
def dedup_lookback(spark, sf_dir):
    """Live rows that start within the look-back before now or later."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start_time"), F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("deleted_at"))
    return sel.started_since(sel.live(rows), events_now(), 20).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 6 <> 0 UNION ALL SELECT event_id + 1000000 FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND ts <= TIMESTAMP '2024-01-22' AND event_id % 6 <> 0")
def upcoming_window(spark, sf_dir):
    """Upcoming live events: all of them, and those of a week (ids shifted)."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("start_time"), F.when(F.col("event_id") % 6 == 0, F.col("ts")).alias("deleted_at"))
    now = F.lit("2024-01-15").cast("timestamp")
    return sel.starting(rows, now).select("event_id").union(sel.starting(rows, now, 7).select(F.col("event_id") + 1_000_000))
