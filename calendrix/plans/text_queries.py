"""Text and URL queries over the test tables, each with its DuckDB twin where RE2 can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from calendrix.functions import semantics as s
from calendrix.functions import text as t
from calendrix.functions import urls as u
from calendrix.plans.base import events_now, orders_now, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


NORM = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"SELECT p_partkey, {NORM.format('p_name')} AS norm FROM part")
def normalized_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.normal_title(F.col("p_name")).alias("norm"))


@query(f"SELECT {NORM.format('text')} AS norm, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 AND {NORM.format('text')} <> ''")
def duplicate_titles(spark, sf_dir):
    norm = table(spark, sf_dir, "documents").select(t.normal_title(F.col("text")).alias("norm")).where("norm <> ''")
    return norm.groupBy("norm").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


PRINTS_SQL = f"""list_filter([{NORM.format('c_name')}, {NORM.format('c_mktsegment')}, {NORM.format("c_name || ' ' || c_mktsegment")}], lambda x: length(x) >= 6)"""


@query(f"SELECT c_custkey, array_to_string({PRINTS_SQL}, '|') AS prints FROM customer")
def venue_fingerprints(spark, sf_dir):
    prints = t.venue_fingerprints(F.col("c_name"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(prints, "|").alias("prints"))


@query(r"""SELECT page_id, lower(split_part(regexp_replace(url, '/$', ''), '?', 1)) AS url_key FROM pages""")
def url_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.event_url_key(F.col("url")).alias("url_key"))


HOST_SQL = r"regexp_replace(lower(regexp_replace(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)', 1), ''), ':\d*$', '')), '^www\.', '')"
PATH_SQL = r"regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)', 2)"


@query(f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.host(F.col("url")).alias("host"))


@query(f"SELECT page_id, lower({HOST_SQL} || regexp_replace({PATH_SQL}, '/$', '')) AS normal FROM pages")
def url_normal(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.normal_url(F.col("url")).alias("normal"))


@query(f"""SELECT page_id, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '')[1] AS slug, list_filter(string_split({PATH_SQL}, '/'), lambda x: x <> '')[-1] AS last FROM pages""")
def url_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", u.slug(F.col("url")).alias("slug"), u.last_segment(F.col("url")).alias("last"))


#: Every other page takes one of these, so that each rule sees URLs of both kinds.
MORE_URLS = [
    "https://www.meetup.com/group/events/123456/", "https://lu.ma/abc", "https://www.eventbrite.com/e/talk-1", "https://www.meetup.com/find/?q=ai", "https://linkedin.com/in/x", "https://site.example/events/talk", "https://sub.luma.com/x",
    "https://allevents.in/events/x", "https://site.example/list?page=2", "https://site.example/search?keywords=ai", "no url", "https://luma.com/x",
]
URLS_SQL = f"(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_quoted(MORE_URLS)}[CAST(page_id // 2 % {len(MORE_URLS)} AS INTEGER) + 1] ELSE url END AS url FROM pages)"


def mixed_urls(spark, sf_dir):
    listed = F.get(F.array(*map(F.lit, MORE_URLS)), (F.floor(F.col("page_id") / 2) % len(MORE_URLS)).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, listed).otherwise(F.col("url")).alias("url"))


@query(f"""SELECT page_id, {_any('url', u.SINGLE_EVENT)} AS single_event, {_any('url', u.BROAD_SEARCH)} AS broad_search,
len(list_filter({_quoted(u.SKIPPED_HOSTS)}, lambda h: contains(lower(url), h))) > 0 AS skipped,
NOT contains(url, 'allevents.in') AND (contains(url, 'meetup.com/') OR contains(url, 'eventbrite.com/e/') OR contains(url, 'lu.ma/') OR regexp_matches(url, '/events?/[^/?]')) AS event_page,
contains(lower(url), 'eventdisplay=past') OR contains(lower(url), 'tribe-bar-date=') OR {_any('url', u.PAGED_OR_PAST)} AS paged,
coalesce(len(list_filter({_quoted(u.PLATFORMS)}, lambda d: {HOST_SQL} = d OR ends_with({HOST_SQL}, '.' || d))) > 0, false) AS platform FROM {URLS_SQL}""")
def url_class(spark, sf_dir):
    url = F.col("url")
    classes = {"single_event": u.single_event(url), "broad_search": u.broad_search(url), "skipped": u.skipped_host(url), "event_page": u.event_page(url), "paged": u.paged_or_past(url), "platform": u.shared_platform(url)}
    return mixed_urls(spark, sf_dir).select("page_id", *[c.alias(n) for n, c in classes.items()])


@query(f"""SELECT page_id, CASE {HOST_SQL} WHEN 'lu.ma' THEN 'luma' WHEN 'luma.com' THEN 'luma' WHEN 'meetup.com' THEN 'meetup' END AS parser, {HOST_SQL} IS NOT NULL AS takes FROM {URLS_SQL}""")
def url_routing(spark, sf_dir):
    return mixed_urls(spark, sf_dir).select("page_id", u.parser_for(F.col("url")).alias("parser"), u.submission(F.col("url"), F.lit(None).cast("string")).alias("takes"))


MORE_TITLES = ["TBD", "AI night", "", "<div class=x>", ".card { color: red }", "!!!! ---- ????", "Untitled", "function() { return 1 }", "A talk on agents", "{{title}}"]


@query(f"""SELECT doc_id, length(trim(text)) < 5 OR list_contains({_quoted(t.PLACEHOLDER_TITLES)}, lower(trim(text))) AS placeholder,
text = '' OR {_any('text', t.MALFORMED_TITLE_PATTERNS)} OR length(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) < length(text) * 0.3 AS malformed,
length(text) < 3 OR {_any('text', t.GARBAGE_PATTERNS)} OR length(regexp_replace(text, '[^a-zA-Z0-9\\s]', '', 'g')) < length(text) * 0.4 AS garbage FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_quoted(MORE_TITLES)}[CAST(doc_id // 3 % {len(MORE_TITLES)} AS INTEGER) + 1] ELSE text END AS text FROM documents)""".replace("\\\\s", "\\s"))
def title_quality(spark, sf_dir):
    listed = F.get(F.array(*map(F.lit, MORE_TITLES)), (F.floor(F.col("doc_id") / 3) % len(MORE_TITLES)).cast("int"))
    text = F.col("text")
    return table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, listed).otherwise(text)).select("doc_id", t.placeholder_title(text).alias("placeholder"), t.malformed_title(text).alias("malformed"), t.garbage_text(text).alias("garbage"))


LOCAL, OUTSIDE = ["tion ", "edre", "schen"], ["queas", "pourle", "zuer", "oreor"]


@query(f"""SELECT doc_id, CASE WHEN city IS NOT NULL THEN 'false' WHEN here THEN 'true' END AS is_local,
CASE WHEN city IS NOT NULL THEN 'outside: ' || city WHEN here THEN 'local term' WHEN length(text) >= 4 THEN 'no local term' ELSE 'no location' END AS reason FROM (
SELECT doc_id, text, list_filter({_quoted(OUTSIDE)}, lambda w: contains(lower(text), w))[1] AS city, length(text) >= 4 AND len(list_filter({_quoted(LOCAL)}, lambda w: contains(lower(text), w))) > 0 AS here FROM documents)""")
def location_tristate(spark, sf_dir):
    """The three-way location rule with a lexicon of the test texts."""
    verdict = t.location_verdict(F.col("text"), outside=OUTSIDE, local=LOCAL)
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("v")).select("doc_id", F.col("v.is_local").cast("string").alias("is_local"), "v.reason")


@query(r"""SELECT page_id, md5(substring(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'),
'(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g')), 1, 3000)) AS snippet FROM pages""")
def text_snippet(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.text_snippet(F.col("html")).cast("binary")).alias("snippet"))


MORE_HTML = ["", "<script type='application/ld+json'>", "<script id=__NEXT_DATA__>", "<p>Join us</p>", "<p>March 5</p>", "<p>3/5/2026</p>"]


@query(r"""SELECT page_id, contains(lower(html), 'application/ld+json') AS has_json_ld, contains(lower(html), '__next_data__') AS has_next_data,
regexp_matches(lower(html), '\b(register|rsvp|attend|event|meetup|join us|upcoming)\b') AS has_event_keywords,
regexp_matches(lower(html), '\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+[0-9]{1,2}') OR regexp_matches(lower(html), '[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}') AS has_date_patterns FROM (SELECT page_id, coalesce(html, '') || """ + f"{_quoted(MORE_HTML)}[CAST(page_id % {len(MORE_HTML)} AS INTEGER) + 1] AS html FROM pages)")
def content_signals(spark, sf_dir):
    listed = F.get(F.array(*map(F.lit, MORE_HTML)), (F.col("page_id") % len(MORE_HTML)).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), listed)).select("page_id", t.content_signals(F.col("html")).alias("s")).select("page_id", "s.*")


def _entities_sql() -> str:
    out = "html"
    for name, char in t.ENTITIES.items():
        out = f"replace({out}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT page_id, md5({out}) AS decoded FROM pages"


@query(_entities_sql())
def entity_decode(spark, sf_dir):
    """The test pages have no numeric entities, so the named ones decide."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(t.decode_entities(F.col("html")).cast("binary")).alias("decoded"))


def _clean_sql() -> str:
    out = "text"
    for pattern, to in [(r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"#{1,6}\s*", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", r"\1"), (r"\\n", " "), (r"\s+", " ")]:
        out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return f"""SELECT doc_id, CASE WHEN length(flat) > 200 THEN regexp_replace(substring(flat, 1, 200), '\\s+\\S*$', '') || '...' ELSE flat END AS description
FROM (SELECT doc_id, trim({out}) AS flat FROM documents WHERE text <> '')"""


@query(_clean_sql())
def clean_description(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", t.clean_description(F.col("text")).alias("description"))


MESSAGES = ["read timeout", "Rate limit hit", "Unexpected token <", "selector .x missing", "socket closed", "SSL certificate expired", "connection reset"]
CODES = ["", "ETIMEDOUT", "ENOTFOUND", "EPIPE"]
STATUSES = ["NULL", "429", "503", "404", "403", "200"]


@query(f"""SELECT event_id, CASE WHEN status = 429 OR status BETWEEN 500 AND 599 THEN 'transient' WHEN status IN (404, 410, 401, 403) THEN 'permanent'
WHEN code IN ('ETIMEDOUT', 'EPIPE', 'ENOTFOUND') THEN 'transient' WHEN contains(message, 'timeout') OR contains(message, 'Rate limit') THEN 'transient'
WHEN contains(message, 'Unexpected token') OR contains(message, 'selector') THEN 'structural' ELSE 'transient' END AS type,
CASE WHEN contains(message, 'timeout') THEN 'timeout' WHEN contains(message, 'Rate limit') THEN 'rate limit' WHEN contains(message, 'SSL') THEN 'ssl' WHEN contains(message, 'connection') THEN 'network' ELSE 'other' END AS category
FROM (SELECT event_id, {_quoted(MESSAGES)}[CAST(event_id % 7 AS INTEGER) + 1] AS message, {_quoted(CODES)}[CAST(event_id % 4 AS INTEGER) + 1] AS code, [{', '.join(STATUSES)}][CAST(event_id % 6 AS INTEGER) + 1] AS status FROM events)""")
def error_classification(spark, sf_dir):
    pick = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), (F.col("event_id") % len(values)).cast("int"))
    status = pick([None if x == "NULL" else int(x) for x in STATUSES], "int")
    named = table(spark, sf_dir, "events").select("event_id", pick(MESSAGES, "string").alias("message"), pick(CODES, "string").alias("code"), status.alias("status"))
    verdict = t.scrape_error(F.col("message"), F.col("status"), F.col("code"))
    return named.select("event_id", verdict["type"].alias("type"), t.error_category(F.col("message")).alias("category"))


@query("""SELECT event_id, CASE WHEN value > 90 OR event_id % 6 + 1 <= 1 THEN 'transient' WHEN event_id % 6 + 1 <= 3 THEN 'structural' ELSE 'permanent' END AS kind FROM events""")
def silent_failure(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.silent_failure((F.col("value") > 90).cast("int"), F.col("event_id") % 6).alias("kind"))


@query("""SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago', '%Y-%m-%d %H:%M:%S') AS local_time, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) <> CAST(((ts + INTERVAL 3 HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Chicago' AS DATE) AS multi_day FROM events""")
def local_time_format(spark, sf_dir):
    zone, end = "America/Chicago", F.col("ts") + F.expr("INTERVAL 3 HOURS")
    return table(spark, sf_dir, "events").select(
        "event_id", F.date_format(F.from_utc_timestamp("ts", zone), "yyyy-MM-dd HH:mm:ss").alias("local_time"), (s.local_day(F.col("ts"), zone) != s.local_day(end, zone)).alias("multi_day")
    )


@query("SELECT o_orderkey, round(greatest(0.01::DOUBLE, pow(0.9::DOUBLE, date_diff('microsecond', o_orderdate, TIMESTAMP '2001-08-02') / 86400000000.0::DOUBLE)), 6) AS priority FROM orders")
def priority_decay(spark, sf_dir):
    decayed = s.decayed_priority(F.col("o_orderdate"), F.lit(None).cast("timestamp"), orders_now())
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(decayed, 6).alias("priority"))


@query("""SELECT event_id, CASE WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS ago, CASE WHEN length(CAST(event_id AS VARCHAR)) < 6 THEN lpad(CAST(event_id AS VARCHAR), 6, '0') ELSE CAST(event_id AS VARCHAR) END AS padded
FROM (SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '2024-01-31') // 60000000 AS m FROM events)""")
def time_ago(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", s.time_ago(F.col("ts"), events_now()).alias("ago"), s.zero_padded(F.col("event_id")).alias("padded"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    found = t.embedded_json(F.concat(F.lit("Answer: "), F.col("props"), F.lit(" end")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json(found), "$.k", "bigint").alias("k"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts <= TIMESTAMP '2024-01-31'")
def calendar_window(spark, sf_dir):
    now = events_now()
    return table(spark, sf_dir, "events").where(F.col("ts").between(now - F.make_dt_interval(F.lit(30)), now)).select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01'")
def upcoming_filter(spark, sf_dir):
    start = F.col("o_orderdate").cast("string")
    return table(spark, sf_dir, "orders").where(s.upcoming(start, F.lit("2001-07-01").cast("timestamp"))).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_type), ' '), ['promo', 'large']) AND p_brand IN ('Brand#2', 'Brand#8', 'Brand#13', 'Brand#21') AND p_size < 30")
def faceted_filter(spark, sf_dir):
    from calendrix.operators.selection import faceted

    parts = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("audience"), F.col("p_brand").alias("level"), (F.col("p_size") < 30).alias("is_free"))
    return faceted(parts, ["promo", "large"], ["Brand#2", "Brand#8", "Brand#13", "Brand#21"], free_only=True).select("p_partkey")


@query("""SELECT doc_id, CAST(CASE WHEN n IS NOT NULL THEN abs(added - n) <= greatest(1, floor(n * 0.5 + 0.5)) WHEN vague THEN added > 0 END AS VARCHAR) AS hit,
CASE WHEN n IS NOT NULL THEN CASE WHEN abs(added - n) <= greatest(1, floor(n * 0.5 + 0.5)) THEN 0.1::DOUBLE ELSE -0.1::DOUBLE END WHEN vague THEN CASE WHEN added > 0 THEN 0.05::DOUBLE ELSE -0.05::DOUBLE END ELSE 0::DOUBLE END AS delta
FROM (SELECT doc_id, doc_id % 9 AS added, CASE WHEN doc_id % 3 = 0 THEN doc_id % 10 END AS n, doc_id % 3 = 1 AS vague FROM documents)""")
def experiment_scoring(spark, sf_dir):
    stated = F.concat(F.lit("Expect about "), (F.col("doc_id") % 10).cast("string"), F.lit(" more events"))
    said = F.when(F.col("doc_id") % 3 == 0, stated).when(F.col("doc_id") % 3 == 1, "will add some").otherwise("hard to say")
    return table(spark, sf_dir, "documents").select("doc_id", t.experiment_verdict(said, F.col("doc_id") % 9).alias("v")).select("doc_id", F.col("v.hit").cast("string").alias("hit"), "v.delta")


@query("""SELECT p_partkey, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE ['general'] END, ',') AS audience, CASE WHEN p_size % 3 = 0 THEN 'advanced' ELSE 'all-levels' END AS level
FROM (SELECT p_partkey, p_size, list_filter([CASE WHEN p_size % 2 = 0 THEN 'developers' ELSE 'nobody' END, CASE WHEN p_size % 5 = 0 THEN 'students' ELSE '' END], lambda x: x IN ('developers', 'students')) AS k FROM part)""")
def sanitized_classification(spark, sf_dir):
    size = F.col("p_size")
    audience = F.array(F.when(size % 2 == 0, "developers").otherwise("nobody"), F.when(size % 5 == 0, "students").otherwise(""))
    level = F.when(size % 3 == 0, "advanced").otherwise("expert")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.sanitised_audience(audience), ",").alias("audience"), t.sanitised_level(level).alias("level"))
