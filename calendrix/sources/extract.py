"""Events out of HTML pages: JSON-LD, embedded page data, Apollo state and event cards.

One small parser turns a page into event rows; Spark deals out the pages, and all that follows
(entity decoding, past events, first of each URL) are DataFrame operations. Strategies are tried in
order and the first that finds anything is kept.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.semantics import upcoming
from calendrix.functions.text import decode_entities
from calendrix.operators.selection import first_of
from calendrix.sources.schemas import SCRAPED

FIELDS = ["title", "description", "url", "source_event_id", "start_time", "end_time", "venue_name", "address", "is_free", "organizer", "image_url", "raw_date"]
DATE_KEYS, DEPTH = ("startDate", "start_at", "dateTime", "start_time"), 8


class Page(HTMLParser):
    """Scripts, and cards: elements with event in their class, with heading, link, time and place."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.scripts, self.cards, self.links, self.open, self.into, self.void = [], [], [], [], None, {"img", "br", "meta", "link", "input", "hr", "source"}
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        kind = a.get("class", "").lower()
        if tag == "script":
            self.into = ("script", a)
            self.scripts.append((a, []))
            return
        if tag in self.void:
            return
        if tag == "a" and a.get("href"):
            self.links.append((a["href"], []))
        card = self.open[-1][1] if self.open else None
        if card is None and "event" in kind.split("__")[0] and tag in ("article", "div", "li", "section", "a"):
            card = {"title": [], "venue": [], "date": [], "link": None}
            self.cards.append(card)
        part = None
        if card is not None:
            if tag in ("h2", "h3", "h4") or "title" in kind:
                part = "title"
            elif "location" in kind or "venue" in kind:
                part = "venue"
            elif tag == "time" or "date" in kind:
                part = "date"
                if a.get("datetime"):
                    card.setdefault("stamp", a["datetime"])
            if tag == "a" and a.get("href") and not card["link"]:
                card["link"] = a["href"]
        self.open.append((tag, card, part))

    def handle_endtag(self, tag):
        if tag == "script":
            self.into = None
        elif any(t == tag for t, *_ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if self.into:
            self.scripts[-1][1].append(data)
            return
        if self.links and any(tag == "a" for tag, *_ in self.open):
            self.links[-1][1].append(data)
        if self.open and self.open[-1][1] is not None:
            part = next((p for _, c, p in reversed(self.open) if p and c is self.open[-1][1]), None)
            if part:
                self.open[-1][1][part].append(data)


def _json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _text(value) -> str | None:
    if isinstance(value, dict):
        value = value.get("name") or value.get("url") or value.get("value")
    if isinstance(value, list):
        value = value[0] if value else None
        return _text(value)
    return None if value in (None, "") else str(value)


def _address(value) -> str | None:
    if isinstance(value, dict):
        parts = [value.get(k) for k in ("streetAddress", "addressLocality", "addressRegion", "address", "city", "state")]
        return ", ".join(str(p) for p in parts if p) or None
    return _text(value)


def _event(item: dict, url: str, name: str | None) -> dict:
    """The canonical fields of an event object under any of the known spellings."""
    first = lambda *keys: next((item[k] for k in keys if item.get(k) not in (None, "")), None)
    place = first("location", "venue", "geo_address_info") or {}
    place = place[0] if isinstance(place, list) and place else place
    free = first("isAccessibleForFree", "is_free")
    if free is None and str(_price(item)) in ("0", "0.0"):
        free = True
    return {
        "title": _text(first("name", "title")),
        "description": _text(first("description")),
        "url": _text(first("url", "eventUrl")) or url,
        "source_event_id": _text(first("identifier", "id", "api_id")),
        "start_time": _text(first(*DATE_KEYS)),
        "end_time": _text(first("endDate", "end_at", "endTime", "end_time")),
        "venue_name": _text(place.get("name")) if isinstance(place, dict) else _text(place),
        "address": _address(place["address"] if isinstance(place.get("address"), dict) else place) if isinstance(place, dict) else None,
        "is_free": free if isinstance(free, bool) else None,
        "organizer": _text(first("organizer", "calendar")) or name,
        "image_url": _text(first("image", "cover_url", "imageUrl")),
    }


def _price(item: dict):
    offers = item.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers
    return offer.get("price") if isinstance(offer, dict) else None


def _is_event(item) -> bool:
    kinds = item.get("@type") if isinstance(item, dict) else None
    return any(str(k).endswith("Event") for k in (kinds if isinstance(kinds, list) else [kinds]) if k)


def linked_data(scripts) -> list[dict]:
    """Event objects of the JSON-LD scripts: at the top, in @graph or in an ItemList."""
    todo = [_json("".join(body)) for a, body in scripts if a.get("type") == "application/ld+json"]
    found = []
    while todo:
        item = todo.pop(0)
        if isinstance(item, list):
            todo = item + todo
        elif _is_event(item):
            found.append(item)
        elif isinstance(item, dict):
            main = item.get("mainEntity") if isinstance(item.get("mainEntity"), dict) else {}
            inner = [*(item.get("@graph") or []), *(item.get("itemListElement") or []), *(main.get("itemListElement") or []), item.get("item")]
            todo = [x for x in inner if isinstance(x, (dict, list))] + todo
    return found


def page_props(scripts) -> dict:
    """The page properties embedded by the site's framework; {} without any."""
    for a, body in scripts:
        text = "".join(body)
        if a.get("id") == "__NEXT_DATA__" or "pageProps" in text:
            data = _json(text) or _json(text[text.find("{") : text.rfind("}") + 1]) or {}
            props = data.get("props", {}).get("pageProps") or data.get("pageProps")
            if props:
                return props
    return {}


def _walk(value, depth: int = 0) -> list[dict]:
    """Objects that look like events, not searched further themselves, to a bounded depth."""
    if depth > DEPTH or not isinstance(value, (dict, list)):
        return []
    if isinstance(value, dict):
        name = value.get("name") or value.get("title")
        if isinstance(name, str) and len(name) >= 5 and any(value.get(k) for k in DATE_KEYS):
            return [value]
    inner = value.values() if isinstance(value, dict) else value
    return [e for x in inner for e in _walk(x, depth + 1)]


def apollo_events(state: dict, url: str, name: str | None) -> list[dict]:
    """Event entities with the venues that they refer to."""
    out = []
    for key, item in state.items():
        if key.startswith("Event:") and isinstance(item, dict) and item.get("title") and item.get("dateTime"):
            venue = state.get((item.get("venue") or {}).get("__ref"), {}) or {}
            event = _event({**item, "venue": venue, "url": None}, url, name)
            event["url"] = urljoin("https://www.meetup.com/", item["eventUrl"]) if item.get("eventUrl") else url
            event["is_free"] = True if item.get("feeType") == "NO_FEE" else None
            out.append(event)
    return out


#: Where calendar pages keep their arrays of events, in the order in which they are tried.
ARRAY_PATHS = (
    ("data", "events"), ("events",), ("initialData", "data", "featured_items"), ("initialData", "featured_items"),
    ("calendarData", "events"), ("calendar", "events"),
)


def _at(value, path):
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _arrays(value, depth: int = 0) -> list[list]:
    """Arrays of objects, to a bounded depth."""
    if depth > 5 or not isinstance(value, (dict, list)):
        return []
    own = [value] if isinstance(value, list) and any(isinstance(x, dict) for x in value) else []
    return own + [a for x in (value.values() if isinstance(value, dict) else value) for a in _arrays(x, depth + 1)]


def array_events(items: list, url: str, name: str | None) -> list[dict]:
    """Events of a calendar's array: those with a name and a slug or URL. The first host organises
    before the calendar does."""
    out = []
    for item in (x for x in items if isinstance(x, dict)):
        event = item.get("event") if isinstance(item.get("event"), dict) else item
        slug = event.get("url") or event.get("slug")
        if not event.get("name") or not isinstance(slug, str) or not slug:
            continue
        host = (item.get("hosts") or [{}])[0].get("name")
        geo = item.get("geo_address_info") or event.get("geo_address_info") or {}
        made = _event({**event, "startDate": event.get("start_at") or event.get("startDate"), "url": None}, url, host or (item.get("calendar") or {}).get("name") or name)
        made |= {"url": slug if slug.startswith("http") else urljoin("https://lu.ma/", slug), "source_event_id": slug, "is_free": (item.get("ticket_info") or {}).get("is_free")}
        made |= {"venue_name": geo.get("address") or geo.get("place_name") or event.get("venue_name"), "address": geo.get("full_address") or geo.get("short_address")}
        made["organizer"] = host or (item.get("calendar") or {}).get("name") or name
        out.append(made)
    return out


def calendar_arrays(props: dict, url: str, name: str | None) -> list[dict]:
    """Events of the first known array that gives any, else of the largest array that does."""
    known = [a for a in (_at(props, path) for path in ARRAY_PATHS) if isinstance(a, list)]
    for items in [*known, *sorted(_arrays(props), key=len, reverse=True)]:
        found = array_events(items, url, name)
        if found:
            return found
    return []


# Pages of the platform that are no events.
NO_EVENTS = ("about", "contact", "pricing", "login", "signup", "explore", "discover")


def linked(links, url: str, name: str | None) -> list[dict]:
    """Events that a platform's page only links to: one path segment, and a text of 4 to 199 characters."""
    out, own = {}, url.rstrip("/").rsplit("/", 1)[-1]
    for href, body in links:
        at, title = urljoin(url, href), " ".join("".join(body).split())
        host, _, path = at.partition("://")[2].partition("/")
        path = path.partition("?")[0].partition("#")[0]
        if host.removeprefix("www.") not in ("lu.ma", "luma.com") or "/" in path or len(path) < 3 or path in NO_EVENTS or path == own:
            continue
        if 3 < len(title) < 200:
            out.setdefault(at, {"title": title, "url": at, "source_event_id": path, "organizer": name})
    return list(out.values())


def patched_venue(event: dict, props: dict) -> dict:
    """An event without a venue, with that of the first event of the page's Apollo state that has one."""
    state = props.get("__APOLLO_STATE__")
    if event.get("venue_name") or not isinstance(state, dict):
        return event
    for key, item in state.items():
        place = state.get((item.get("venue") or {}).get("__ref")) if key.startswith("Event:") and isinstance(item, dict) else None
        if place:
            parts = [place.get(k) for k in ("address", "city", "state")]
            return {**event, "venue_name": place.get("name"), "address": ", ".join(p for p in parts if p) or None}
    return event


def embedded(props: dict, url: str, name: str | None) -> list[dict]:
    """Events of the page properties: known places first, then anything that looks like one."""
    if not props:
        return []
    start = props.get("initialData") if isinstance(props.get("initialData"), dict) else {}
    data = start.get("data") if isinstance(start.get("data"), dict) else {}
    listed = start.get("events") or data.get("events")
    if isinstance(listed, list) and listed:
        return [_event({**(x.get("event") or x), "calendar": x.get("calendar") or (x.get("hosts") or [None])[0]}, url, name) for x in listed if isinstance(x, dict)]
    if isinstance(data.get("event"), dict) and data["event"].get("start_at"):
        return [_event({**data["event"], "calendar": data.get("calendar") or (data.get("hosts") or [None])[0]}, url, name)]
    if isinstance(props.get("__APOLLO_STATE__"), dict):
        return apollo_events(props["__APOLLO_STATE__"], url, name)
    if isinstance(props.get("event"), dict):
        return [_event(props["event"], url, name)]
    if isinstance(props.get("events"), list) and props["events"] and not any("event" in x for x in props["events"] if isinstance(x, dict)):
        return [_event(x, url, name) for x in props["events"] if isinstance(x, dict)]
    return calendar_arrays(props, url, name) or [_event(x, url, name) for x in _walk(props)]


def carded(cards: list[dict], url: str, name: str | None) -> list[dict]:
    join = lambda parts: " ".join("".join(parts).split()) or None
    return [
        {"title": join(c["title"]), "url": urljoin(url, c["link"]), "venue_name": join(c["venue"]), "raw_date": join(c["date"]) or c.get("stamp"), "start_time": c.get("stamp"), "organizer": name}
        for c in cards
        if join(c["title"]) and c["link"]
    ]


def page_events(html: str, url: str, name: str | None) -> tuple[str | None, int, list[dict]]:
    """(strategy, candidates, events) of a page."""
    page = Page(html)
    found = [_event(x, url, name) for x in linked_data(page.scripts)]
    props = page_props(page.scripts)
    if found:
        return "json-ld", len(found), [patched_venue(e, props) for e in found] if len(found) == 1 else found
    found = embedded(props, url, name)
    if found:
        return "nextdata", len(found), found
    found = carded(page.cards, url, name)
    if found:
        return "css-selectors", len(page.cards), found
    found = linked(page.links, url, name)
    return ("html-links" if found else None), max(len(page.cards), len(found)), found


def scraped(pages: DataFrame) -> DataFrame:
    """Event rows of pages(page_id, url, html, source), one without a title for a page without events."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, url, html, source in pdf[["page_id", "url", "html", "source"]].itertuples(index=False):
                strategy, candidates, events = page_events(html or "", url or "", source)
                for n, e in enumerate(events or [{}]):
                    rows.append({**{f: e.get(f) for f in FIELDS}, "url": e.get("url") or url, "page_id": page_id, "source": source, "strategy": strategy, "candidates": candidates, "position": n})
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCRAPED.split(", ")])
            yield frame.astype({"is_free": "object"})

    return pages.select("page_id", "url", "html", "source").mapInPandas(run, SCRAPED)


def scrape(pages: DataFrame, as_of: Column) -> DataFrame:
    """Decoded events of pages that are not over, the first of each URL of a page."""
    rows = scraped(pages).where("title IS NOT NULL")
    decoded = rows.withColumns({c: decode_entities(F.col(c)) for c in ("title", "description")})
    return first_of(decoded.where(upcoming(F.col("start_time"), as_of)), ["page_id", "url"], ["position"])


def scrape_results(pages: DataFrame) -> DataFrame:
    """(page_id, status, strategy, candidates, events) of each page: parse_uncertain without events."""
    counts = scraped(pages).groupBy("page_id").agg(F.max("strategy").alias("strategy"), F.max("candidates").alias("candidates"), F.count("title").alias("events"))
    return counts.withColumn("status", F.when(F.col("events") > 0, "success").otherwise("parse_uncertain"))


def search_events(results: DataFrame, details: DataFrame) -> DataFrame:
    """Search results(link, title, start_time, venue_name) of event pages, with the scraped details
    of their link first; without details only results with a title of 10 characters and a start."""
    from calendrix.functions.urls import event_page

    kept = results.where(event_page(F.col("link")))
    known = first_of(details.withColumnRenamed("url", "link"), ["link"], ["position"]).select("link", *[F.col(c).alias("_" + c) for c in ("title", "start_time", "venue_name")])
    met = kept.join(known, "link", "left").where(F.col("_title").isNotNull() | ((F.length("title") >= 10) & F.col("start_time").isNotNull()))
    return met.select("link", *[F.coalesce("_" + c, c).alias(c) for c in ("title", "start_time", "venue_name")])
