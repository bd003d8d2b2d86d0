"""Parsers by source type, as a table function of SQL: one page gives the rows of its events.

A parser is a function (html, url, name) -> (strategy, candidates, events), registered under the type of
source that it reads. The type comes from the URL where that names a known platform, else from the source, else it
is the general chain of layouts; unknown types go the general way too. A parser that fails gives one row
with its error and no event, a page without events one row of status parse_uncertain.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendrix.functions.dates import MONTHS, mistagged_local
from calendrix.functions.urls import parser_for
from calendrix.sources import extract

Parser = Callable[[str, str, "str | None"], "tuple[str | None, int, list[dict]]"]
GENERAL, NAME = "scrape", "parse_page"
PARSERS: dict[str, Parser] = {}

ROW = "scraper string, status string, strategy string, candidates int, position int, title string, event_url string, start_time string, end_time string, venue_name string, address string, error string"


def parser(*types: str) -> Callable[[Parser], Parser]:
    """Registers a function under source types."""

    def add(fn: Parser) -> Parser:
        PARSERS.update(dict.fromkeys(types, fn))
        return fn

    return add


@parser(GENERAL, "generic", "api")
def general(html: str, url: str, name: str | None):
    """Linked data, embedded page data, cards, links: the first layout that has events."""
    return extract.page_events(html, url, name)


def _linked(html: str, url: str, name: str | None) -> list[dict]:
    return [extract._event(x, url, name) for x in extract.linked_data(extract.Page(html).scripts)]


@parser("local-cards")
def local_cards(html: str, url: str, name: str | None):
    """Linked data, else cards; times are local whatever offset they carry, which is marked by a leading ~."""
    found = _linked(html, url, name)
    strategy = "json-ld"
    if not found:
        found, strategy = extract.carded(extract.Page(html).cards, url, name), "css-selectors"
    for event in found:
        for field in ("start_time", "end_time"):
            if event.get(field):
                event[field] = "~" + event[field]
    return (strategy if found else None), len(found), found


#: "February 10-11, 2027" and "February 10, 2027", in any case.
RANGE = re.compile(rf"(?i)\b({'|'.join(MONTHS)})\s+(\d{{1,2}})(?:\s*[-–]\s*(\d{{1,2}}))?,\s+(\d{{4}})\b")


@parser("date-range")
def date_range(html: str, url: str, name: str | None):
    """Linked data, else one event by the first range of dates in the page's text, from its first to its last day."""
    found = _linked(html, url, name)
    if found:
        return "json-ld", len(found), found
    text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", html))
    met = RANGE.search(text)
    if not met:
        return None, 0, []
    month, first, last, year = MONTHS.index(met[1].lower()) + 1, int(met[2]), int(met[3] or met[2]), met[4]
    day = lambda n: f"{year}-{month:02d}-{n:02d}"
    return "date-range", 1, [{"title": name, "url": url, "start_time": day(first), "end_time": day(last)}]


class ParsePage:
    """The table function parse_page(type, url, html, name)."""

    def eval(self, type: str, url: str, html: str, name: str) -> Iterator[tuple]:  # noqa: A002
        kind = type if type in PARSERS else GENERAL
        try:
            strategy, candidates, events = PARSERS[kind](html or "", url or "", name)
        except Exception as error:  # a parser's failure is a result of its page
            yield kind, "error", None, 0, 0, None, url, None, None, None, None, f"{error.__class__.__name__}: {error}"[:200]
            return
        if not events:
            yield kind, "parse_uncertain", strategy, candidates, 0, None, url, None, None, None, None, None
        for n, e in enumerate(events):
            yield kind, "success", strategy, candidates, n, e.get("title"), e.get("url") or url, *(e.get(f) for f in ("start_time", "end_time", "venue_name", "address")), None


def register(spark: SparkSession, name: str = NAME) -> None:
    """Makes the parsers a table function of the session's SQL."""
    spark.udtf.register(name, F.udtf(ParsePage, returnType=ROW))


def probed(pages: DataFrame, suggested: Column | None = None, tier: str = "probation") -> DataFrame:
    """pages(page_id, url, html, source) with the rows of parse_page beside them: the events of newly found
    pages on their way in, with source_url and a tier of their own. suggested: a page's type where its URL tells none."""
    spark = pages.sparkSession
    register(spark)
    kind = F.coalesce(parser_for(F.col("url")), suggested if suggested is not None else F.lit(None).cast("string"), F.lit(GENERAL))
    asked = pages.select("page_id", F.col("url").alias("source_url"), "html", "source", kind.alias("kind"))
    rows = spark.sql(
        f"SELECT p.page_id, p.source_url, p.source, e.* FROM {{asked}} p, LATERAL {NAME}(p.kind, p.source_url, p.html, p.source) e", asked=asked
    )
    local = lambda c: F.when(F.startswith(c, F.lit("~")), F.date_format(mistagged_local(F.substring(c, 2, 100)), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.col(c))
    return rows.withColumns({c: local(c) for c in ("start_time", "end_time")}).withColumn("source_tier", F.lit(tier))


def tried(pages: DataFrame, type_: str, sample: int = 2) -> DataFrame:
    """One parser run over pages(page_id, url, html, source) for a look: (page_id, status, strategy, candidates,
    events, error, sample), the sample being the first titles. An unknown type is an error that lists the known ones."""
    if type_ not in PARSERS:
        raise ValueError(f"unknown type {type_}; known are {', '.join(sorted(PARSERS))}")
    register(pages.sparkSession)
    asked = pages.select("page_id", "url", "html", "source")
    rows = pages.sparkSession.sql(f"SELECT p.page_id, e.* FROM {{asked}} p, LATERAL {NAME}(:type, p.url, p.html, p.source) e", {"type": type_}, asked=asked)
    first = lambda c: F.first(c, ignorenulls=True)
    titles = F.sort_array(F.collect_list(F.when((F.col("position") < sample) & F.col("title").isNotNull(), F.struct("position", "title"))))
    return rows.groupBy("page_id").agg(
        first("status").alias("status"), first("strategy").alias("strategy"), F.max("candidates").alias("candidates"), F.count("title").alias("events"), first("error").alias("error"),
        F.transform(titles, lambda x: x["title"]).alias("sample"),
    )
