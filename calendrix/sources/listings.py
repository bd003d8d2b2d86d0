"""Listings whose events are on other pages: links and lists of URLs, joined to the pages behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.dates import month_day_line, slash_line
from calendrix.functions.semantics import or_else
from calendrix.functions.text import garbage_text, listing_location
from calendrix.functions.urls import absolute, best_link

LINK = r'(?is)<a\b[^>]*?href="([^"]+)"[^>]*>(.*?)</a>'
SCRIPT = r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'
LISTED = "STRUCT<`@type`: STRING, mainEntity: STRUCT<itemListElement: ARRAY<STRUCT<url: STRING>>>>"
RESPONSE = "STRUCT<entries: ARRAY<STRUCT<event: STRUCT<name: STRING, url: STRING, start_at: STRING, end_at: STRING>, calendar: STRUCT<name: STRING>>>>"


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, position, link, text) of the anchors of pages(page_id, url, html), made absolute."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("body"))
    each = pages.select("page_id", "url", F.posexplode(found).alias("position", "a"))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col("a.body"), r"<[^>]+>", " "), r"\s+", " "))
    return each.select("page_id", "position", absolute(F.col("a.href"), F.col("url")).alias("link"), text.alias("text"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """(page_id, link): the URLs of the item lists of pages' JSON-LD collections, each once."""
    script = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("json"))
    graph = F.from_json("json", f"STRUCT<`@graph`: ARRAY<{LISTED}>>")["@graph"]
    own = F.from_json("json", LISTED)
    items = script.select("page_id", F.explode(F.coalesce(graph, F.array(own))).alias("x")).where("x.`@type` = 'CollectionPage'")
    return items.select("page_id", F.explode("x.mainEntity.itemListElement.url").alias("link")).where("link <> ''").distinct()


def behind(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The pages(page_id, url, html) that links(link) lead to, each once: a second stage to scrape."""
    return pages.join(links.select(F.col("link").alias("url")).distinct(), "url", "left_semi")


def ticket_links(listings: DataFrame, pages: DataFrame, ticket: str = "eventbrite.com/e/", detail: str = r"/events/[a-z]+-\d{1,2}-\d{4}$") -> DataFrame:
    """(link): ticket pages that listings link to, or the detail pages that they link to; without
    their query, each once."""
    first = page_links(listings).select("link")
    second = page_links(behind(first.where(F.col("link").rlike(detail)), pages)).select("link")
    return first.union(second).where(F.contains("link", F.lit(ticket))).select(F.split_part("link", F.lit("?"), F.lit(1)).alias("link")).distinct()


def text_line_events(lines: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Events of lines(page_id, line) that state a date and a title, with the best of the page's links."""
    parsed = slash_line(F.col("line"), as_of)
    title = F.coalesce(or_else(parsed["title"]), F.trim(F.split_part("line", F.lit("|"), F.lit(-1))))
    start = F.coalesce(parsed["start"], month_day_line(F.col("line"), as_of))
    known = links.groupBy("page_id").agg(F.array_sort(F.collect_set("link")).alias("links"))  # of one page
    met = lines.withColumns({"title": title, "start_time": start}).where("start_time IS NOT NULL").join(known, "page_id", "left")
    return met.select("page_id", "title", "start_time", best_link(F.split(F.lower("title"), r"[^a-z0-9]+"), F.col("links")).alias("url"))


def venue_feed(events: DataFrame, venue: str) -> DataFrame:
    """Events of a feed that name a venue in their venue or address."""
    return events.where(F.contains(F.lower(F.concat_ws(" ", "venue_name", "address")), F.lit(venue.lower())))


def tiles(events: DataFrame) -> DataFrame:
    """Cards without those whose title is no text or that are in another city."""
    here = listing_location(F.col("title"), F.col("venue_name"), F.col("url"))
    return events.where(~garbage_text(F.col("title")) & F.coalesce(here, F.lit(True)))


def api_events(responses: DataFrame) -> DataFrame:
    """(id, position, title, url, start_time, end_time, organizer) of API responses(id, body): what
    the calendar's API says, where its pages say nothing."""
    entry = responses.select("id", F.posexplode(F.from_json("body", RESPONSE)["entries"]).alias("position", "x"))
    named = entry.where("x.event.name <> '' AND x.event.url <> ''")
    return named.select("id", "position", F.col("x.event.name").alias("title"), F.concat(F.lit("https://lu.ma/"), F.col("x.event.url")).alias("url"), F.col("x.event.start_at").alias("start_time"), F.col("x.event.end_at").alias("end_time"), F.col("x.calendar.name").alias("organizer"))


def search_results(pages: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, url, title, snippet): the first results of search responses(query_id, body)."""
    rows = pages.select("query_id", F.posexplode(F.from_json("body", "STRUCT<organic_results: ARRAY<STRUCT<link: STRING, title: STRING, snippet: STRING>>>")["organic_results"]).alias("position", "r"))
    return rows.where(F.col("position") < most).select("query_id", F.col("r.link").alias("url"), "r.title", "r.snippet")
