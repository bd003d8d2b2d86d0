"""What readers see: addresses, dates, badges, links and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else
from calendrix.functions.text import any_of, content_signals, text_snippet
from calendrix.functions.urls import host

# Patterns of style sheets that were once stored as places.
STYLE_PATTERNS = ["%.style-%", "%position:%", "%display:%", "%font-size:%"]
#: Of database source types to scrapers; all others are scraped.
SCRAPERS = {"meetup": "meetup", "luma": "luma"}


def full_address(*parts: Column) -> Column:
    """The different non-empty parts, in order; null without any."""
    known = F.array_distinct(F.array_compact(F.array(*[or_else(p) for p in parts])))
    return F.when(F.size(known) > 0, F.array_join(known, ", "))


def without_styles(place: Column) -> Column:
    """Null for a place that is a piece of a style sheet."""
    return F.when(~F.coalesce(any_of([place.like(p) for p in STYLE_PATTERNS]), F.lit(False)), place)


def date_parts(at: Column, zone: str) -> Column:
    """struct of the five formats in which cards and details give a start."""
    local = F.from_utc_timestamp(at, zone)
    formats = {"month": "MMM", "day": "d", "weekday": "EEE", "clock": "h:mm a", "full": "EEEE, MMMM d, yyyy"}
    return F.struct(*[F.date_format(local, f).alias(name) for name, f in formats.items()])


def minutes_of(seconds: Column) -> Column:
    """Whole minutes of a run, rounded half up; null for none."""
    return F.when(seconds > 0, F.floor(seconds / 60 + 0.5).cast("int"))


def first_errors(errors: Column, most: int = 3) -> Column:
    """The first messages of an array of struct(error, message): error, else message, else a default."""
    said = F.transform(errors, lambda e: F.coalesce(or_else(e["error"]), or_else(e["message"]), F.lit("Unknown error")))
    return F.slice(said, 1, most)


def shortened(text: Column, longest: int) -> Column:
    return F.substring(text, 1, longest)


def device(agent: Column) -> Column:
    low = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(low.rlike("iphone|ipad|ipod"), "ios").when(F.contains(low, F.lit("android")), "android").otherwise("desktop")


def map_link(address: Column, kind: Column) -> Column:
    """The link that opens an address on a device; a space is %20."""
    query = F.replace(F.url_encode(address), F.lit("+"), F.lit("%20"))
    prefix = F.when(kind == "android", "geo:0,0?q=").when(kind == "ios", "https://maps.apple.com/?q=").otherwise("https://www.google.com/maps/search/?api=1&query=")
    return F.concat(prefix, query)


def trust_badge(score: Column) -> Column:
    """struct(label, percent): percent as a whole number in text, rounded half up."""
    label = F.when(score.isNull(), "Unknown").when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")
    return F.struct(label.alias("label"), F.floor(score * 100 + 0.5).cast("int").cast("string").alias("percent"))


def source_name(name: Column, url: Column) -> Column:
    return F.coalesce(or_else(name), host(url), url)


def direction(observed: Column, expected: Column) -> Column:
    """over from half as much again, under below half, else within; null without both."""
    return F.when(observed > expected * 1.5, "over").when(observed < expected * 0.5, "under").when(observed.isNotNull() & expected.isNotNull(), "within")


def fetch_diagnostics(status: Column, html: Column, found: Column) -> Column:
    """struct(http_status, page_size, signals, snippet) of a fetched page; the snippet only where
    nothing was found."""
    return F.struct(
        status.alias("http_status"),
        F.length(html).alias("page_size"),
        F.when(html.isNotNull(), content_signals(html)).alias("signals"),
        F.when((found == 0) & (html != ""), text_snippet(html)).alias("snippet"),
    )


def source_result(name: Column, url: Column, events: Column, status: Column, scraper: Column, diagnostics: Column) -> Column:
    """One scrape as a run's log has it; missing events are none."""
    return F.struct(name.alias("name"), url.alias("url"), F.coalesce(events, F.lit(0)).alias("events"), F.coalesce(status, F.lit("success")).alias("scrape_status"), scraper.alias("scraper_type"), diagnostics.alias("diagnostics"))


def result_events(result: Column, bare: Column) -> Column:
    """The events of a scrape, given in a result struct or as a bare array; none are an empty array."""
    none = F.array_compact(F.array(F.get(bare, F.lit(0))))  # of the right type, and empty where it is used
    return F.coalesce(result["events"], bare, none)


def scraper_for(source_type: Column) -> Column:
    return F.coalesce(*[F.when(source_type == t, F.lit(s)) for t, s in SCRAPERS.items()], F.lit("scrape"))


def venue_line(text: Column) -> Column:
    """struct(venue, address) of a `Venue: name, street, town` line, else of the first words after
    venue, location or address anywhere."""
    named = F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\s*Venue:\s*([^\n]+)", 1)), F.lit(""))
    loose = F.nullif(F.trim(F.regexp_extract(text, r"(?i)(?:venue|location|address)[:\s]+([^,\n]+(?:,\s*[^,\n]+){0,3})", 1)), F.lit(""))
    parts = F.transform(F.split(F.coalesce(named, loose), ","), lambda x: F.trim(x))
    return F.struct(F.nullif(F.get(parts, F.lit(0)), F.lit("")).alias("venue"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, 1000), ", ")).alias("address"))


def missing_settings(required: dict[str, object]) -> list[str]:
    """Names of required settings without a value, in order."""
    return [name for name, value in required.items() if value in (None, "")]
