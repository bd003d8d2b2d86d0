import pytest
from pyspark.sql import functions as F

from calendrix.functions import urls


def values(spark, column, *rows, schema="u string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_keys(spark):
    got = values(spark, urls.event_url_key(F.col("u")), "https://A.com/E/", "https://a.com/e?x=1", "https://a.com/e/?x=1", "https://a.com/e#f", "https://a.com//", None)
    assert got == ["https://a.com/e", "https://a.com/e", "https://a.com/e/", "https://a.com/e#f", "https://a.com/", None]
    got = values(spark, urls.event_id_key(F.col("s"), F.col("i")), ("luma", "1"), ("luma", ""), ("luma", None), ("", "1"), schema="s string, i string")
    assert got == ["luma|1", None, None, None]


def test_parts(spark):
    rows = ["https://www.Lu.ma:443/AITX/x/?a#b", "http://sub.meetup.com", "not a url", "", None]
    assert values(spark, urls.host(F.col("u")), *rows) == ["lu.ma", "sub.meetup.com", None, None, None]
    assert values(spark, urls.normal_url(F.col("u")), *rows) == ["lu.ma/aitx/x", "sub.meetup.com", "not a url", "", None]
    assert values(spark, urls.normal_url(F.col("u"), lower=False), rows[0]) == ["lu.ma/AITX/x"]
    assert values(spark, urls.slug(F.col("u")), *rows) == ["AITX", None, None, None, None]
    assert values(spark, urls.last_segment(F.col("u")), *rows) == ["x", None, None, None, None]
    links = [("/e/1", "https://a.com/list/x"), ("b", "https://a.com/list/x"), ("//c.com/d", "https://a.com/"), ("https://d.com", "https://a.com"), ("b", "https://a.com")]
    assert values(spark, urls.absolute(F.col("l"), F.col("b")), *links, schema="l string, b string") == ["https://a.com/e/1", "https://a.com/list/b", "https://c.com/d", "https://d.com", "https://a.com/b"]


@pytest.mark.parametrize("predicate, yes, no", [
    (urls.single_event, ["https://x.org/event/abc", "https://x.org/events/abc/", "https://www.eventbrite.com/e/1", "https://meetup.com/g/events/123", "https://x.org/news/2024/a"], ["https://x.org/events", "https://lu.ma/aitx"]),
    (urls.broad_search, ["https://meetup.com/find/?k=1", "https://x.org/Search?a", "https://x.org/discover", "https://x.org/?q=ai"], ["https://x.org/discovery", "https://x.org/"]),
    (urls.skipped_host, ["https://LinkedIn.com/in", "https://netflix.com/"], ["https://lu.ma/", "https://x.org"]),
    (urls.event_page, ["https://meetup.com/a", "https://lu.ma/x", "https://x.org/event/1", "https://x.org/events/1"], ["https://allevents.in/events/1", "https://x.org/events/", "https://eventbrite.com/d/x"]),
    (urls.paged_or_past, ["https://x.org/?page=2", "https://x.org/page/3/", "https://x.org/?eventDisplay=past", "https://x.org/events/month/2026-04/"], ["https://x.org/?pages=a", "https://x.org/"]),
    (urls.shared_platform, ["https://lu.ma/x", "https://www.meetup.com/y", "https://a.eventbrite.co.uk/z"], ["https://notlu.ma.org", "nonsense", "https://xmeetup.com"]),
])
def test_classes(spark, predicate, yes, no):
    assert values(spark, predicate(F.col("u")), *yes, *no) == [True] * len(yes) + [False] * len(no)


def test_routing_and_submissions(spark):
    rows = ["https://lu.ma/x", "https://www.luma.com/y", "https://meetup.com/z", "https://sub.lu.ma/x", "https://x.org", "bad", None]
    assert values(spark, urls.parser_for(F.col("u")), *rows) == ["luma", "luma", "meetup", None, None, None, None]
    got = values(spark, urls.submission(F.col("u"), F.col("h")), (" https://a.com/x ", None), ("https://a.com", "bot"), ("nope", ""), ("", ""), schema="u string, h string")
    assert got == [True, False, False, False]


def test_best_link(spark):
    df = spark.createDataFrame([(["ai", "agents", "night"], ["https://a.com/ai", "https://a.com/agents-night", "https://b.com/night-agents"]), (["xyz"], ["https://a.com"])], "w array<string>, l array<string>")
    assert [r[0] for r in df.select(urls.best_link(F.col("w"), F.col("l"))).collect()] == ["https://a.com/agents-night", None]
