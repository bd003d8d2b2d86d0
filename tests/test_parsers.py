"""The parser registry behind SQL, and the functions that SQL users call."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calendrix.sources import parsers, sql

PAGES = "page_id long, url string, html string, source string"
BOTH = '<script type="application/ld+json">{"@type":"Event","name":"Ld talk","startDate":"2030-01-01T10:00:00Z"}</script>February 10-11, 2030'


def test_two_types_give_different_events_for_one_page(spark):
    html = "<p>Save the date: FEBRUARY 10-11, 2030</p><div class='event-card'><h3>Card talk</h3><a href='/c/1'>go</a></div>"
    pages = spark.createDataFrame([(1, "https://a.example/", html, "Summit")], PAGES)
    as_type = lambda t: [(r.title, r.start_time, r.end_time) for r in parsers.probed(pages, F.lit(t)).collect()]
    assert as_type("date-range") == [("Summit", "2030-02-10", "2030-02-11")]
    assert as_type("scrape") == as_type("of no such type") == [("Card talk", None, None)]


def test_the_url_tells_the_type_before_the_source_does(spark):
    @parsers.parser("luma")
    def cards(html, url, name):
        return "luma", 1, [{"title": "by platform"}]

    try:
        pages = spark.createDataFrame([(1, "https://lu.ma/x", BOTH, "a"), (2, "https://b.example", BOTH, "b"), (3, None, None, None)], PAGES)
        got = {r.page_id: (r.scraper, r.status, r.title, r.source_tier) for r in parsers.probed(pages, F.lit("date-range")).collect()}
    finally:
        del parsers.PARSERS["luma"]
    assert got == {1: ("luma", "success", "by platform", "probation"), 2: ("date-range", "success", "Ld talk", "probation"), 3: ("date-range", "parse_uncertain", None, "probation")}


def test_a_failing_parser_is_a_result(spark):
    @parsers.parser("broken")
    def broken(html, url, name):
        raise KeyError("nothing")

    try:
        got = parsers.probed(spark.createDataFrame([(1, "https://a.example", "x", "a")], PAGES), F.lit("broken")).first()
    finally:
        del parsers.PARSERS["broken"]
    assert (got.status, got.error, got.title) == ("error", "KeyError: 'nothing'", None)


def test_local_times_lose_their_offset(spark):
    pages = spark.createDataFrame([(1, "https://a.example", BOTH, "a")], PAGES)
    assert parsers.probed(pages, F.lit("local-cards")).first().start_time == "2030-01-01T16:00:00Z"


def test_trial_of_one_parser(spark):
    pages = spark.createDataFrame([(1, "https://a.example", BOTH, "a"), (2, "https://a.example", "", "a")], PAGES)
    got = {r.page_id: (r.status, r.events, r.sample) for r in parsers.tried(pages, "generic").collect()}
    assert got == {1: ("success", 1, ["Ld talk"]), 2: ("parse_uncertain", 0, [])}
    with pytest.raises(ValueError, match="date-range"):
        parsers.tried(pages, "no such type")


def test_sql_functions_and_view(spark):
    t0 = dt.datetime(2026, 1, 5)
    rows = [("/a", "human", "x", t0), ("/a", "human", "x", t0), ("/a", "human", None, t0), ("/a", "human", "x", t0 + dt.timedelta(days=1)), ("/a", "bot", "gptbot 1", t0), ("/a", "bot", "curl", t0), ("/b", "human", "GPTBot", t0)]
    views = spark.createDataFrame(rows, "page string, visitor_type string, user_agent string, created_at timestamp")
    events = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(days=2)), (3, None)], "id long, start_time timestamp")
    sql.register(spark, views, events, F.lit("2026-01-06").cast("timestamp"))
    one = lambda text: spark.sql(text).first()[0]
    assert one("SELECT visitors FROM unique_visitor_count('/a', 'human')") == 3
    assert one("SELECT visits FROM ai_crawler_count('/a')") == 1 and one("SELECT visits FROM ai_crawler_count('/b')") == 0
    assert one("SELECT visitors FROM unique_visitor_count('/none', 'human')") == 0
    assert [r.id for r in spark.sql("SELECT id FROM upcoming_events").collect()] == [2]
