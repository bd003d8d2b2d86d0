import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from calendrix.functions import display
from calendrix.operators import metrics
from calendrix.sources import extract, tables
from calendrix.streaming import page_views


def now():
    return F.lit("2026-01-01 00:00:00").cast("timestamp")


def page(*bodies):
    return "<html><body>" + "".join(bodies) + "</body></html>"


def ld(data):
    return f'<script type="application/ld+json">{json.dumps(data)}</script>'


def next_data(props):
    return f'<script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": props}})}</script>'


EVENT = {"@type": "BusinessEvent", "name": "AI &amp; You", "startDate": "2026-02-01T18:00:00Z", "url": "https://a.org/e/1", "location": {"name": "Hall", "address": {"streetAddress": "1 A St", "addressLocality": "Austin"}}, "organizer": {"name": "Org"}, "offers": [{"price": 0}]}


def run(spark, *htmls):
    rows = [(i, "https://a.org/list", h, "a.org") for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, source string")


def test_linked_data(spark):
    over = {**EVENT, "startDate": "2025-02-01T18:00:00Z", "url": "https://a.org/e/0"}
    pages = run(spark, page(ld(EVENT), ld(EVENT)), page(ld({"@graph": [{"@type": "ItemList", "itemListElement": [{"item": EVENT}, over]}]})), page(ld([EVENT]), "<script>{bad</script>"), page(), None)
    got = extract.scrape(pages, now()).orderBy("page_id").collect()
    assert [(r.page_id, r.title, r.venue_name, r.address, r.is_free, r.organizer, r.strategy) for r in got] == [(i, "AI & You", "Hall", "1 A St, Austin", True, "Org", "json-ld") for i in range(3)]
    status = {r.page_id: r.status for r in extract.scrape_results(pages).collect()}
    assert status == {0: "success", 1: "success", 2: "success", 3: "parse_uncertain", 4: "parse_uncertain"}


def test_embedded_data(spark):
    luma = {"initialData": {"data": {"events": [{"event": {"name": "Luma night", "start_at": "2026-03-01T00:00:00Z", "url": "https://lu.ma/x"}, "calendar": {"name": "Cal"}}]}}}
    single = {"initialData": {"data": {"event": {"name": "One event", "start_at": "2026-03-02T00:00:00Z"}, "hosts": [{"name": "Host"}]}}}
    apollo = {"__APOLLO_STATE__": {"Event:1": {"title": "Meetup!", "dateTime": "2026-03-03T00:00:00Z", "eventUrl": "/g/events/1", "venue": {"__ref": "Venue:9"}, "feeType": "NO_FEE"}, "Venue:9": {"name": "Bar", "address": "2 B St", "city": "Austin"}, "Event:2": {"title": "no date"}}}
    deep = {"a": {"b": [{"c": {"title": "Deep event", "start_time": "2026-03-04T00:00:00Z"}}, {"title": "tiny", "start_time": "x"}]}}
    got = extract.scrape(run(spark, *[page(next_data(p)) for p in (luma, single, apollo, deep)]), now()).orderBy("page_id").collect()
    assert [(r.title, r.url, r.organizer, r.venue_name) for r in got] == [
        ("Luma night", "https://lu.ma/x", "Cal", None), ("One event", "https://a.org/list", "Host", None),
        ("Meetup!", "https://www.meetup.com/g/events/1", "a.org", "Bar"), ("Deep event", "https://a.org/list", "a.org", None),
    ]
    assert got[2].address == "2 B St, Austin" and got[2].is_free


def test_cards(spark):
    card = '<div class="event-card"><h3>Card <b>one</b></h3><a href="/e/1">go</a><time datetime="2026-05-01T00:00:00Z">May 1</time><span class="venue">Hall</span></div><div class="event-card"><h3>No link</h3></div>'
    row = extract.scrape(run(spark, page(card)), now()).first()
    assert (row.title, row.url, row.raw_date, row.venue_name, row.strategy) == ("Card one", "https://a.org/e/1", "May 1", "Hall", "css-selectors")


def test_search_results_take_details_first(spark):
    details = extract.scrape(run(spark, page(ld({**EVENT, "url": "https://meetup.com/x"}))), now())
    rows = [("https://meetup.com/x", "Search title", None, None), ("https://lu.ma/y", "Long enough title", "2026-02-02", "V"), ("https://lu.ma/z", "Short", "2026-02-02", None), ("https://blog.org/", "Not an event page", "2026-02-02", None)]
    got = extract.search_events(spark.createDataFrame(rows, "link string, title string, start_time string, venue_name string"), details).collect()
    assert {r.link: r.title for r in got} == {"https://meetup.com/x": "AI & You", "https://lu.ma/y": "Long enough title"}


def test_json_ld_export(spark):
    rows = [(str(i), f"T{i}", dt.datetime(2026, 1 + 6 * i, 1, 18), dt.datetime(2026, 7, 1) if i == 0 else None, "", None, None, "u", "d", "Org" if i else "", None) for i in range(2)]
    df = spark.createDataFrame(rows, "id string, title string, start_time timestamp, end_time timestamp, venue_name string, location string, address string, url string, description string, organizer string, is_free boolean")
    items = tables.json_ld_items(df, "America/Chicago", "Austin, TX")
    out = json.loads(tables.json_ld(items, "Events", "All of them").first().json)
    first, second = out["itemListElement"]
    assert (out["@type"], out["name"], first["position"], second["position"]) == ("ItemList", "Events", 1, 2)
    assert first["startDate"] == "2026-01-01T12:00:00-06:00" and first["endDate"] == "2026-06-30T19:00:00-05:00" and second["startDate"] == "2026-07-01T13:00:00-05:00"
    assert first["location"] == {"@type": "Place", "name": "Austin, TX", "address": "Austin, TX"}
    assert "organizer" not in first and second["organizer"]["name"] == "Org" and "endDate" not in second and "isAccessibleForFree" not in second
    assert tables.iso_local(F.lit("2026-01-01").cast("timestamp"), "Asia/Kolkata") is not None
    assert df.select(tables.iso_local(F.lit("2026-01-01").cast("timestamp"), "Asia/Kolkata")).first()[0].endswith("+05:30")


def test_writes_can_be_switched_off(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, name string")
    path = str(tmp_path / "t")
    assert tables.append(rows, path, dry_run=True).count() == 1 and not (tmp_path / "t").exists()
    tables.append(rows, path)
    tables.append(rows, path)
    assert tables.read(spark, path, "id long, name string").count() == 2
    tables.snapshot(rows, str(tmp_path / "u"), dry_run=True)
    assert not (tmp_path / "u").exists()
    assert tables.snapshot(rows, str(tmp_path / "u")).count() == 1


def test_exactly_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, name string")
    assert tables.one(rows, "id", 1).first().name == "a"
    for value in (2, 3):
        with pytest.raises(Exception, match="id has rows"):
            tables.one(rows, "id", value).collect()


def test_result_shapes(spark):
    df = spark.sql("SELECT named_struct('events', array(1, 2)) AS r, CAST(NULL AS array<int>) AS bare UNION ALL SELECT NULL, array(3) UNION ALL SELECT NULL, NULL")
    got = [r[0] for r in df.select(display.result_events(F.col("r"), F.col("bare"))).collect()]
    assert got == [[1, 2], [3], []]
    assert display.missing_settings({"a": "x", "b": "", "c": None}) == ["b", "c"]


def test_streamed_views_match_batch(spark, tmp_path):
    views = spark.createDataFrame([("p", "GPTBot", dt.datetime(2026, 1, 1, h)) for h in range(3)] + [("p", None, dt.datetime(2026, 1, 1)), ("p", "x", dt.datetime(2026, 1, 2)), ("p", "late", dt.datetime(2026, 1, 9))], "page string, user_agent string, created_at timestamp")
    views.write.parquet(str(tmp_path / "in"))
    stream = page_views.daily_visitors(spark.readStream.schema(views.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("visitors").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    read = lambda df: {(r.day.start.day, r.visitor_type): r.visitors for r in df.collect()}
    batch = read(page_views.daily_visitors(views))
    assert batch == {(1, "bot"): 1, (1, "human"): 1, (2, "human"): 1, (9, "human"): 1}
    assert read(spark.table("visitors")) == {k: v for k, v in batch.items() if k[0] != 9}


def test_metrics_on_edges(spark):
    empty = spark.createDataFrame([], "run_id long, started timestamp, discovered long, added long, errors long")
    row = metrics.window_averages(empty, "started", now()).first()
    assert (row.runs, row.avg_added, row.sum_added) == (0, None, None)
    assert metrics.run_totals(empty).first().success_percent is None
    grades = spark.createDataFrame([(1, n, "B" if n != 3 else None) for n in range(8)], "k long, n long, grade string")
    assert tuple(metrics.grade_streak(grades, "k", [F.desc("n")], "grade").first()) == (1, "B", 4, False)
    gaps = metrics.calendar_gaps(spark.createDataFrame([(dt.datetime(2026, 1, 2),)], "at timestamp"), "at", dt.date(2026, 1, 1), 3)
    assert sorted(str(r.day) for r in gaps.collect()) == ["2026-01-01", "2026-01-03"]
