"""Text predicates and normalisers: examples pinned by the survey, as DataFrame tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from calendrix.functions import dates, semantics, text


def values(spark, column, *rows, schema="a string, b string"):
    width = len(schema.split(","))
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) + (None,) * (width - 1) for r in rows], schema)
    return [r[0] for r in df.select(column).collect()]


def test_titles(spark):
    good = ["AI Meetup: Agents & Tools", "Hack Night 2026", "R&D talk (LLMs)"]
    bad = [".event-title { color: red", "position: relative", "DISPLAY : block", "<div>x</div>", "[data] x", "#main {", "a &:hover b", "@media print", "@import x", "function (a) {}", "const x = 1", "var y", "}}{{", "!!! ??? ---", "", None]
    assert values(spark, text.malformed_title(F.col("a")), *good, *bad) == [False] * 3 + [True] * len(bad)
    names = ["TBD", " tba ", "Coming Soon", "To be announced", "untitled", "event", "New Event", "test", "abcd", "Event night", "Tested"]
    assert values(spark, text.placeholder_title(F.col("a")), *names) == [True] * 9 + [False] * 2
    garbage = ["ab", "margin: 0", "font-size: 1px", '{ "a": 1', "%%%%%a", None]
    assert values(spark, text.garbage_text(F.col("a")), "Plain text here", *garbage) == [False] + [True] * 6


def test_location_has_three_values(spark):
    verdict = text.location_verdict(F.col("a"), F.col("b"))
    rows = [("Capital Factory", "701 Brazos St, Austin, TX"), ("Hall", "Houston, near Austin St"), ("Somewhere", "Main St"), (None, None), ("", ""), ("Zoom", "Virtual"), ("TX", None)]
    got = values(spark, verdict, *rows)
    assert [r.is_local for r in got] == [True, False, None, None, None, False, None]
    assert [r.reason for r in got] == ["local term", "outside: houston", "no local term", "no location", "no location", "outside: virtual", "no location"]
    assert values(spark, text.listing_location(F.col("a"), F.col("b")), ("SXSW talk", None), ("Berlin", "Austin"), ("x", None)) == [True, False, None]


def test_venues(spark):
    prints = lambda a, b: text.venue_fingerprints(F.col(a), F.col(b))
    rows = [("Capital Factory", "701 Brazos", "capital factory (5th fl)", None), ("Hall", None, "Hall", None), ("The Domain", "11410 Century", None, "11410 Century Oaks, Austin"), (None, None, "Capital Factory", None)]
    got = values(spark, text.venues_overlap(prints("a", "b"), prints("c", "d")), *rows, schema="a string, b string, c string, d string")
    assert got == [True, False, True, False]
    assert values(spark, prints("a", "b"), ("Abc", "12 Long Street")) == [["12longstreet", "abc12longstreet"]]


def test_entities_and_snippets(spark):
    rows = ["Tom &amp; &lt;b&gt; &#38; &#8211; &#x2019;s &amp;lt; &middot;", "plain", "&#65;&#66;", None]
    assert values(spark, text.decode_entities(F.col("a")), *rows) == ["Tom & <b> & – ’s < &middot;", "plain", "AB", None]
    html = "<style>p{}</style><p>One</p>\n<SCRIPT src=x>var a='<p>';</SCRIPT> <b>two</b>"
    assert values(spark, text.text_snippet(F.col("a")), html) == ["One two"]
    long = "word " * 60
    assert values(spark, text.clean_description(F.col("a")), "**Bold** _it_ [x](http://y)\n# Head", long, "", None) == ["Bold it x Head", "word " * 39 + "word...", None, None]


def test_classification_and_agents(spark):
    df = spark.createDataFrame([(["developers", "wizards"], "expert"), (["x"], "beginner"), (None, None)], "a array<string>, b string")
    got = df.select(text.sanitised_audience(F.col("a")), text.sanitised_level(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(["developers"], "all-levels"), (["general"], "beginner"), (["general"], "all-levels")]
    agents = ["Mozilla GPTBot", "claude-web", "Slurp", "Nokia6100", "Mozilla/5.0", None]
    assert values(spark, text.visitor_type(F.col("a")), *agents) == ["bot"] * 4 + ["human"] * 2
    assert values(spark, text.ai_crawler(F.col("a")), *agents) == [True, True, False, False, False, False]


def test_errors(spark):
    rows = [("x", 429, ""), ("x", 503, ""), ("x", 404, ""), ("x", 403, ""), ("x", None, "EPIPE"), ("x", None, "ENOTFOUND"), ("Timed out", None, None), ("throttled: throttle", None, ""), ("Unexpected token <", None, ""), ("odd", 200, "")]
    got = values(spark, text.scrape_error(F.col("m"), F.col("s"), F.col("c")), *rows, schema="m string, s int, c string")
    assert [r.type for r in got] == ["transient", "transient", "permanent", "permanent", "transient", "transient", "transient", "transient", "structural", "transient"]
    assert got[3].message == "HTTP 403 (auth required): x" and [r.retryable for r in got[:3]] == [True, True, False]
    kinds = values(spark, text.silent_failure(F.col("a"), F.col("b")), (1, 9), (0, 0), (0, 2), (0, 3), schema="a int, b int")
    assert kinds == ["transient", "transient", "structural", "permanent"]


@pytest.mark.parametrize("minutes, hours", [(779, 12), (780, 13), (0, 0), (2939, 48), (2940, 49)])
def test_hours_are_cut(spark, minutes, hours):
    a = dt.datetime(2026, 1, 1, 12)
    df = spark.createDataFrame([(a, a - dt.timedelta(minutes=minutes))], "a timestamp, b timestamp")
    row = df.select(semantics.hours_between(F.col("a"), F.col("b")), semantics.within_hours(F.col("b"), F.col("a"), 12)).first()
    assert tuple(row) == (hours, hours <= 12)


def test_rounding_costs_and_numbers(spark):
    df = spark.createDataFrame([(2.5, 7), (-2.5, 0), (0.25, 1234567)], "x double, n int")
    assert [r[0] for r in df.select(semantics.round_half_up(F.col("x"))).collect()] == [3.0, -2.0, 0.0]
    assert [r[0] for r in df.select(semantics.zero_padded(F.col("n"))).collect()] == ["000007", "000000", "1234567"]
    assert [round(r[0], 6) for r in df.select(semantics.call_cost(F.lit(100))).limit(1).collect()] == [round(0.1 + 5 * 0.015 + 94 * 0.001, 6)]
    assert df.select(semantics.pass_rate(F.lit(0), F.lit(0))).first()[0] is None
    late = df.select(semantics.upcoming(F.lit("garbage"), F.current_timestamp()), semantics.upcoming(F.lit("2001-01-01T00:00:00Z"), F.current_timestamp())).first()
    assert tuple(late) == (True, False)


def test_dates(spark):
    now = F.lit("2026-03-05 00:00:00").cast("timestamp")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    rows = ["January 20, 2026 | 5:30 PM | Hall", "Jul 4, 2026 11 am", "March 9", "no date"]
    assert values(spark, shown(dates.month_day_line(F.col("a"), now)), *rows) == ["2026-01-20 23:30", "2026-07-04 16:00", "2026-03-09 14:00", None]
    slash = dates.slash_line(F.col("a"), now)
    got = values(spark, F.struct(slash["title"], shown(slash["start"])), "7/14: AI Lunch, 12-1pm", "7/14-16: Summit", "none")
    assert [tuple(r) for r in got] == [("AI Lunch", "2026-07-14 17:00"), ("Summit", "2026-07-14 14:00"), (None, None)]
    assert values(spark, dates.event_year(F.col("a"), now), "W2024-x", "W20") == [2024, 2026]
    assert values(spark, dates.february_year(now), "x") == [2027]
    assert values(spark, shown(dates.calendar_link(F.col("a"))["end"]), "http://c/?dates=20260102T100000Z/20260102T113000Z", "x") == ["2026-01-02 11:30", None]
    assert values(spark, shown(dates.mistagged_local(F.col("a"))), "2026-01-02T10:00:00Z", "2026-07-02T10:00:00+00:00") == ["2026-01-02 16:00", "2026-07-02 15:00"]
    assert values(spark, dates.flat_address(F.col("a")), '{"streetAddress": "1 A St", "addressLocality": "Austin"}', "plain", "{}") == ["1 A St, Austin", "plain", None]


def test_predictions_and_paragraphs(spark):
    verdict = text.experiment_verdict(F.col("a"), F.lit(6))
    got = values(spark, verdict, "expect 10 more events", "about 2 events", "will add some", "who knows", None)
    assert [(r.hit, r.delta) for r in got] == [(True, 0.1), (False, -0.1), (True, 0.05), (None, 0.0), (None, 0.0)]
    body = "Venue: the long hall in the middle of town\nshort\n" + "\n".join(f"Paragraph number {i} is long enough to stay." for i in range(5))
    assert values(spark, text.harvested_paragraphs(F.col("a")), body)[0].count("\n\n") == 2
    assert values(spark, text.embedded_json(F.col("a")), 'Sure: {"a": {"b": 1}} ok', "none", "{bad}") == ['{"a": {"b": 1}}', None, None]
