"""Normalisers, quality predicates, extractors and classifiers over text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
PLACEHOLDER_TITLES = ["tbd", "tba", "coming soon", "to be announced", "to be determined", "untitled", "event", "new event", "test"]
MALFORMED_TITLE_PATTERNS = [
    r"^\s*\.\w+[-\w]*\s*\{",
    r"(?i)position\s*:\s*relative",
    r"(?i)display\s*:\s*block",
    r"^\s*<\w+",
    r"^\s*\[\w+\]",
    r"^\s*#[\w-]+\s*\{",
    r"&:hover",
    r"(?i)^\s*@media",
    r"(?i)^\s*@import",
    r"^\s*function\s*\(",
    r"^\s*const\s+\w+",
    r"^\s*var\s+\w+",
    r"[{}]{2,}",
]
GARBAGE_PATTERNS = [
    r"^\s*\.\w+[-\w]*\s*\{",
    r"^\s*#[\w-]+\s*\{",
    r"(?i)position\s*:\s*\w+",
    r"(?i)display\s*:\s*\w+",
    r"(?i)margin\s*:\s*\d+",
    r"(?i)padding\s*:\s*\d+",
    r"(?i)font-\w+\s*:",
    r"(?i)background\s*:",
    r"^\s*<\w+",
    r"^\s*\{\s*\"",
    r"[{}]{2,}",
    r"(?i)^\s*@media",
    r"(?i)^\s*@import",
    r"&:hover",
]
OUTSIDE_CITIES = [
    "san antonio", "houston", "dallas", "fort worth", "san marcos", "new braunfels", "san francisco", "los angeles", "new york",
    "chicago", "seattle", "denver", "boston", "atlanta", "miami", "phoenix", "portland", "washington dc", "philadelphia", "london",
    "virtual", "online only", "webinar", "remote", "zoom only", "killeen", "waco", "college station", "corpus christi", "el paso",
    "lubbock", "amarillo", "brownsville", "laredo", "mcallen",
]
LOCAL_TERMS = [
    "austin", "atx", "tx 78", "787", "travis county", "williamson county", "hays county", "round rock", "cedar park", "pflugerville",
    "leander", "georgetown", "dripping springs", "lakeway", "bee cave", "capital factory", "domain", "downtown austin", "south congress",
    "east austin", "soco", "6th street", "rainey street", "ut austin", "university of texas", "acc ", "st. edwards", "concordia",
    "sxsw", "south lamar", "mueller", "zilker", "shoal creek", "south austin", "north austin", "west lake", "westlake",
    "brushy creek", "jollyville", "manor rd", "burnet rd", "south first", "congress ave", "lamar blvd",
]
LISTING_OUTSIDE_CITIES = [
    "san antonio", "houston", "dallas", "fort worth", "san marcos", "san francisco", "los angeles", "new york", "chicago", "seattle",
    "denver", "boston", "atlanta", "miami", "phoenix", "portland", "washington dc", "philadelphia", "london", "toronto", "singapore",
    "dubai", "paris", "berlin", "sydney", "mumbai", "bangalore",
]
LISTING_LOCAL_TERMS = ["austin", "atx", "tx 78", "787", "sxsw"]
ENTITIES = {
    "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&nbsp;": " ", "&ndash;": "–", "&mdash;": "—",
    "&lsquo;": "‘", "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&copy;": "©",
    "&reg;": "®", "&trade;": "™",
}
AUDIENCES = ["developers", "business", "researchers", "general", "students"]
LEVELS = ["beginner", "intermediate", "advanced", "all-levels"]
AI_CRAWLERS = ["GPTBot", "ChatGPT", "ClaudeBot", "Claude-Web", "Anthropic", "Google-Extended", "CCBot", "PerplexityBot", "Bytespider", "Amazonbot", "cohere-ai", "Manus-User"]
# Names that hold bot, crawl or spider are found by these words, and so stand here by them alone.
OTHER_BOTS = [
    "HeadlessChrome", "vercel-screenshot", "Dataprovider", "Konqueror", r"Nokia\d", "bot", "crawl", "spider", "Slurp",
    "facebookexternalhit", "WhatsApp", "Screaming Frog",
]
STRUCTURE_WORDS = [
    "unexpected token", "json parse", "cannot read propert", "is not a function", "undefined is not", "null is not",
    "no events found", "expected element", "selector", "queryselector",
]
TRANSIENT_CODES = ["ETIMEDOUT", "ECONNRESET", "ECONNREFUSED", "ECONNABORTED", "EPIPE", "EAI_AGAIN"]


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def matches(text: Column, patterns) -> Column:
    return any_of([text.rlike(p) for p in patterns])


def contains_any(text: Column, words) -> Column:
    """Long lists are searched as an array, so that the generated code stays small."""
    if len(words) > 12:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return any_of([F.contains(text, F.lit(w)) for w in words])


def normal_title(title: Column) -> Column:
    """Lower-cased letters a-z and digits only."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def normal_venue(venue: Column) -> Column:
    return F.coalesce(normal_title(venue), F.lit(""))


def venue_fingerprints(name: Column, address: Column, shortest: int = 6) -> Column:
    """Normalised name, address and both together, those of at least shortest characters."""
    both = normal_venue(F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(address, F.lit(""))))
    return F.filter(F.array(normal_venue(name), normal_venue(address), both), lambda x: F.length(x) >= shortest)


def venues_overlap(a: Column, b: Column) -> Column:
    """Whether a fingerprint of one side contains one of the other."""
    return F.exists(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x)))


def placeholder_title(title: Column) -> Column:
    clean = F.trim(title)
    return (F.length(clean) < 5) | F.lower(clean).isin(PLACEHOLDER_TITLES)


def malformed_title(title: Column) -> Column:
    """Missing titles, code or markup, and titles of under 30 % letters and digits."""
    sparse = F.length(F.regexp_replace(title, "[^a-zA-Z0-9]", "")) < F.length(title) * 0.3
    return F.coalesce((title == "") | matches(title, MALFORMED_TITLE_PATTERNS) | sparse, F.lit(True))


def garbage_text(text: Column) -> Column:
    """Under 3 characters, code or markup, and text of under 40 % letters, digits and spaces."""
    sparse = F.length(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", "")) < F.length(text) * 0.4
    return F.coalesce((F.length(text) < 3) | matches(text, GARBAGE_PATTERNS) | sparse, F.lit(True))


def first_contained(text: Column, words) -> Column:
    """The first word of the list, in its order, that text contains; null if none."""
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), F.lit(0))


def location_verdict(*parts: Column, outside=OUTSIDE_CITIES, local=LOCAL_TERMS, shortest: int = 4) -> Column:
    """struct(is_local, reason): false for an outside city, true for a local term, else null."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]))
    city = first_contained(text, outside)
    here = (F.length(text) >= shortest) & contains_any(text, local)
    is_local = F.when(city.isNotNull(), F.lit(False)).when(here, F.lit(True))
    reason = (
        F.when(city.isNotNull(), F.concat(F.lit("outside: "), city))
        .when(here, F.lit("local term"))
        .when(F.length(text) >= shortest, F.lit("no local term"))
        .otherwise(F.lit("no location"))
    )
    return F.struct(is_local.alias("is_local"), reason.alias("reason"))


def listing_location(*parts: Column) -> Column:
    """The listing scrapers' verdict, with their shorter word lists."""
    return location_verdict(*parts, outside=LISTING_OUTSIDE_CITIES, local=LISTING_LOCAL_TERMS, shortest=0)["is_local"]


def elsewhere(title: Column, venue: Column) -> Column:
    """A title or venue that names another city outright."""
    return F.coalesce(contains_any(F.lower(title), ["houston", "dallas", "san antonio"]), F.lit(False)) | F.coalesce(
        F.contains(F.lower(venue), F.lit("houston")), F.lit(False)
    )


def decode_named_entities(text: Column) -> Column:
    """The known named entities, &amp; first, so that what it uncovers is decoded as well."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)


def _decode_numbers(text: Column, pattern: str, base: int) -> Column:
    """Each code unit as its character. Parts between entities come from a split."""
    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    unit = lambda c: F.decode(F.unhex(F.lpad(F.hex(F.pmod(F.conv(c, base, 10).cast("bigint"), F.lit(65536))), 4, "0")), "UTF-16BE")
    parts = F.split(text, pattern.replace("(", "").replace(")", ""))
    joined = lambda i: F.concat(F.get(parts, i), F.coalesce(unit(F.get(codes, i)), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), joined), "")


def decode_entities(text: Column) -> Column:
    """Named entities, then decimal and hexadecimal ones."""
    return _decode_numbers(_decode_numbers(decode_named_entities(text), "&#([0-9]+);", 10), "&#x([0-9a-fA-F]+);", 16)


def text_snippet(html: Column, longest: int = 3000) -> Column:
    """Text without scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>", "")
    bare = F.regexp_replace(bare, r"(?is)<style[^>]*>.*?</style>", "")
    bare = F.regexp_replace(bare, r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(bare, r"[ \t\r\n\f]+", " ")), 1, longest)


def content_signals(html: Column) -> Column:
    low = F.lower(html)
    months = "january|february|march|april|may|june|july|august|september|october|november|december"
    return F.struct(
        F.contains(low, F.lit("application/ld+json")).alias("has_json_ld"),
        F.contains(low, F.lit("__next_data__")).alias("has_next_data"),
        low.rlike(r"\b(register|rsvp|attend|event|meetup|join us|upcoming)\b").alias("has_event_keywords"),
        (low.rlike(rf"\b({months})\s+[0-9]{{1,2}}") | low.rlike(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}")).alias("has_date_patterns"),
    )


def clean_description(text: Column, longest: int = 200) -> Column:
    """Without markdown, on one line, cut at a word end; null for missing or empty text."""
    rules = [
        (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"__([^_]+)__", "$1"), (r"_([^_]+)_", "$1"), (r"#{1,6}\s*", ""),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"(?s)```.*?```", ""), (r"`([^`]+)`", "$1"), (r"\\n", " "), (r"\s+", " "),
    ]
    flat = F.trim(reduce(lambda c, rule: F.regexp_replace(c, *rule), rules, text))
    short = F.concat(F.regexp_replace(F.substring(flat, 1, longest), r"\s+\S*$", ""), F.lit("..."))
    return F.when(text != "", F.when(F.length(flat) > longest, short).otherwise(flat))


def visitor_type(agent: Column) -> Column:
    bot = agent.rlike("(?i)" + "|".join(AI_CRAWLERS + OTHER_BOTS))
    return F.when(F.coalesce(bot, F.lit(False)), F.lit("bot")).otherwise(F.lit("human"))


def ai_crawler(agent: Column) -> Column:
    return F.coalesce(agent.rlike("(?i)" + "|".join(AI_CRAWLERS)), F.lit(False))


def sanitised_audience(audience: Column) -> Column:
    kept = F.filter(F.coalesce(audience, F.array().cast("array<string>")), lambda x: x.isin(AUDIENCES))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("general")))


def sanitised_level(level: Column) -> Column:
    return F.when(level.isin(LEVELS), level).otherwise(F.lit("all-levels"))


def embedded_json(text: Column) -> Column:
    """What lies between the first { and the last }, null if that is no JSON."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def scrape_error(message: Column, status: Column, code: Column) -> Column:
    """struct(type, message, retryable) by status, then code, then the words of the message."""
    low, state = F.lower(message), status.cast("string")
    cases = [
        ((status == 429) | status.between(500, 599), "transient", F.concat(F.lit("HTTP "), state, F.lit(": "), message)),
        (status.isin(404, 410), "permanent", F.concat(F.lit("HTTP "), state, F.lit(": "), message)),
        (status.isin(401, 403), "permanent", F.concat(F.lit("HTTP "), state, F.lit(" (auth required): "), message)),
        (code.isin(TRANSIENT_CODES), "transient", F.concat(code, F.lit(": "), message)),
        (code == "ENOTFOUND", "transient", F.concat(F.lit("DNS resolution failed: "), message)),
        (contains_any(low, ["timeout", "timed out", "aborted"]), "transient", F.concat(F.lit("Timeout: "), message)),
        (contains_any(low, ["rate limit", "too many requests", "throttle"]), "transient", F.concat(F.lit("Rate limited: "), message)),
        (contains_any(low, STRUCTURE_WORDS), "structural", F.concat(F.lit("Parse/structure error: "), message)),
    ]
    kind, note = F.lit("transient"), F.concat(F.lit("Unknown error: "), message)
    for condition, name, text in reversed(cases):
        condition = F.coalesce(condition, F.lit(False))
        kind, note = F.when(condition, F.lit(name)).otherwise(kind), F.when(condition, text).otherwise(note)
    return F.struct(kind.alias("type"), note.alias("message"), (kind == "transient").alias("retryable"))


def silent_failure(events: Column, empties: Column) -> Column:
    """Kind of a scrape without an error, from how often the source was empty before."""
    n = empties + 1
    return F.when((events > 0) | (n <= 1), F.lit("transient")).when(n <= 3, F.lit("structural")).otherwise(F.lit("permanent"))


def error_category(message: Column) -> Column:
    """The dashboard's coarser category."""
    low = F.lower(message)
    return (
        F.when(F.contains(low, F.lit("timeout")), F.lit("timeout"))
        .when(F.contains(low, F.lit("rate limit")), F.lit("rate limit"))
        .when(contains_any(low, ["ssl", "certificate"]), F.lit("ssl"))
        .when(contains_any(low, ["network", "connection"]), F.lit("network"))
        .otherwise(F.lit("other"))
    )


def harvested_paragraphs(text: Column, shortest: int = 30, most: int = 3, prefixes=("venue:", "when:", "where:", "date:", "time:")) -> Column:
    """The first paragraphs that are long enough and no metadata, divided by blank lines."""
    keep = lambda p: (F.length(p) >= shortest) & ~any_of([F.lower(p).startswith(x) for x in prefixes])
    return F.array_join(F.slice(F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), keep), 1, most), "\n\n")


def is_free(price: Column, accessible: Column | None = None, cost: Column | None = None) -> Column:
    free = price.cast("string").isin("0", "0.0", "0.00")
    if cost is not None:
        free = F.coalesce(free, F.contains(F.lower(cost), F.lit("free")))
    return F.coalesce(accessible, free) if accessible is not None else free


def experiment_verdict(prediction: Column, added: Column) -> Column:
    """struct(hit, delta): a stated number of events within half of it, at least one, of what was
    added; a promise of events by any; else undecided."""
    low = F.lower(F.coalesce(prediction, F.lit("")))
    stated = F.nullif(F.regexp_extract(low, r"([0-9]+)[^0-9]*events?", 1), F.lit("")).cast("bigint")
    near = F.abs(added - stated) <= F.greatest(F.lit(1), F.floor(stated * 0.5 + 0.5))
    vague = contains_any(low, ["new event", "add"])
    hit = F.when(stated.isNotNull(), near).when(vague, added > 0)
    size = F.when(stated.isNotNull(), 0.1).when(vague, 0.05).otherwise(0.0)
    return F.struct(hit.alias("hit"), F.when(hit, size).when(~hit, -size).otherwise(0.0).alias("delta"))
