"""URL normalisers and URL classes, by regular expressions that need no lenient URL parser."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from calendrix.functions.text import any_of, contains_any, matches

# Patterns and hosts that results depend on.
SINGLE_EVENT = [
    r"/event/[^/]+/?$", r"/events/[^/]+/?$", r"eventbrite\.com/e/", r"meetup\.com/[^/]+/events/\d+", r"/event-details/", r"/eventdetails/",
    r"/event\?id=", r"/events/\d{4}-\d{2}-\d{2}/", r"/news/\d{4}/", r"/e/[a-zA-Z0-9-]{20,}", r"/robot-competitions/",
]
BROAD_SEARCH = [
    r"(?i)meetup\.com/find/", r"(?i)meetup\.com/search", r"(?i)eventbrite\.com/d/", r"(?i)/search\?", r"(?i)/find\?", r"(?i)/discover/?$",
    r"(?i)/explore/?$", r"(?i)[?&]keywords?=", r"(?i)[?&]q=",
]
SKIPPED_HOSTS = [
    "linkedin.com", "facebook.com", "twitter.com", "x.com", "youtube.com", "reddit.com", "medium.com", "substack.com", "wikipedia.org",
    "amazon.com", "github.com", "stackoverflow.com", "glassdoor.com", "indeed.com", "crunchbase.com", "yelp.com", "tripadvisor.com",
    "news.google.com", "podcasts.apple.com", "spotify.com", "instagram.com", "allevents.in",
]
PAGED_OR_PAST = [r"(?i)[?&]page=\d", r"(?i)/page/\d+/", r"(?i)/events/month/\d{4}-\d{2}"]
PLATFORMS = ["lu.ma", "luma.com", "meetup.com", "eventbrite.com", "eventbrite.co.uk"]
PARSERS = {"lu.ma": "luma", "luma.com": "luma", "meetup.com": "meetup"}
URL = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)([^?#]*)"


def event_url_key(url: Column) -> Column:
    """One trailing slash off, cut at ?, lower case. The slash goes first: x/?q=1 keeps its slash."""
    return F.lower(F.split_part(F.regexp_replace(url, "/$", ""), F.lit("?"), F.lit(1)))


def event_id_key(source: Column, event_id: Column) -> Column:
    return F.when((source != "") & (event_id != ""), F.concat_ws("|", source, event_id))


def host(url: Column) -> Column:
    """Lower-cased host without port and a leading www.; null if the URL has none."""
    name = F.nullif(F.regexp_extract(url, URL, 1), F.lit(""))
    return F.regexp_replace(F.lower(F.regexp_replace(name, r":\d*$", "")), r"^www\.", "")


def path(url: Column) -> Column:
    return F.when(host(url).isNotNull(), F.regexp_extract(url, URL, 2))


def normal_url(url: Column, lower: bool = True) -> Column:
    """Host and path without a trailing slash; what is no URL is only lower-cased."""
    made = F.concat(host(url), F.regexp_replace(path(url), "/$", ""))
    return F.coalesce(F.lower(made) if lower else made, F.lower(url))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def slug(url: Column) -> Column:
    return F.get(segments(url), F.lit(0))


def last_segment(url: Column) -> Column:
    return F.element_at(F.when(F.size(segments(url)) > 0, segments(url)), -1)


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands in a page of base, for links with a scheme, from the root or beside it."""
    root = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+", 0)
    folder = F.regexp_replace(F.concat(root, path(base)), r"/[^/]*$", "")
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat_ws("/", F.when(F.length(folder) < F.length(root), root).otherwise(folder), link))
    )


def single_event(url: Column) -> Column:
    return matches(url, SINGLE_EVENT)


def broad_search(url: Column) -> Column:
    return matches(url, BROAD_SEARCH)


def skipped_host(url: Column, own: tuple[str, ...] = ()) -> Column:
    """By substring, so that x.com also matches hosts that end in x.com; own are the caller's own hosts."""
    return contains_any(F.lower(url), [*SKIPPED_HOSTS, *own])


def event_page(link: Column) -> Column:
    known = contains_any(link, ["meetup.com/", "eventbrite.com/e/", "lu.ma/"]) | link.rlike(r"/events?/[^/?]")
    return ~F.contains(link, F.lit("allevents.in")) & known


def paged_or_past(url: Column) -> Column:
    return contains_any(F.lower(url), ["eventdisplay=past", "tribe-bar-date="]) | matches(url, PAGED_OR_PAST)


def shared_platform(url: Column) -> Column:
    """On a host of many organisers; false for what is no URL."""
    name = host(url)
    return F.coalesce(any_of([(name == d) | name.endswith("." + d) for d in PLATFORMS]), F.lit(False))


def parser_for(url: Column) -> Column:
    name = host(url)
    return F.coalesce(*[F.when(name == h, F.lit(p)) for h, p in PARSERS.items()])


def submission(url: Column, honeypot: Column) -> Column:
    """A feedback form to be taken: the hidden field is empty and the URL can be read."""
    return (F.coalesce(honeypot, F.lit("")) == "") & host(F.trim(url)).isNotNull()


def best_link(words: Column, links: Column) -> Column:
    """The link with the largest share of words of three characters and more; the first of equals,
    null if none has any. links: array of URLs."""
    long = F.filter(words, lambda w: F.length(w) >= 3)
    scored = F.transform(links, lambda u, i: F.struct(F.size(F.filter(long, lambda w: F.contains(F.lower(u), w))).alias("hits"), (-i).alias("rank"), u.alias("url")))
    best = F.array_max(F.filter(scored, lambda s: s["hits"] > 0))
    return best["url"]
