"""Rate limit pieces, streams with state against batches, and upserts in place."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from calendrix.operators import transitions
from calendrix.sources import updates
from calendrix.streaming import state

T0 = dt.datetime(2026, 1, 5)


def plain_limit(rows, most=3, hours=24):
    kept, out = {}, {}
    for number, who, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        own = [x for x in kept.get(who, []) if at - x < dt.timedelta(hours=hours)]
        out[number] = len(own) < most
        kept[who] = own + [at] * out[number]
    return out | {n: False for n, _, at in rows if not at}


def requests(n=400, seed=3):
    """Four in five of one key, with and without pauses of a day."""
    rng, rows, clock = random.Random(seed), [], T0
    for i in range(n):
        clock += dt.timedelta(hours=rng.choice([0, 0, 1, 5, 9, 23, 24, 25, 49]), minutes=rng.randrange(60))
        rows.append((i, rng.choice(["hot"] * 8 + ["a", None]), clock if rng.random() < 0.97 else None))
    return rows


@pytest.mark.parametrize("hours", [24, 5, 40])
def test_pieces_decide_as_the_whole_does(spark, hours):
    rows = requests()
    df = spark.createDataFrame(rows, "request_id long, who string, at timestamp").repartition(4)
    got = {r.request_id: r.accepted for r in transitions.rate_limited(df, "who", 3, hours).collect()}
    assert got == plain_limit(rows, 3, hours)


def test_a_hot_key_is_cut_at_its_pauses(spark):
    rows = [(i, "hot", T0 + dt.timedelta(days=2 * (i // 10), hours=i % 10)) for i in range(500)]
    df = spark.createDataFrame(rows, "request_id long, who string, at timestamp")
    assert transitions.request_pieces(df, "who", "at", 24).select("piece").distinct().count() == 50


def streamed(spark, rows, schema, make, tmp_path, pieces):
    """All that the stream says of rows that arrive in the given pieces."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, out = tmp_path / "in", str(tmp_path / "out")
    for n, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(folder))
        query = make(spark.readStream.schema(schema).parquet(str(folder))).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).collect()


def test_stream_of_requests_decides_as_the_batch(spark, tmp_path):
    """Rows out of order within the hour; one that is too late is dropped; the last row only moves the clock."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["hot"] * 4 + ["b"]), T0 + dt.timedelta(minutes=40 * i + rng.randrange(30))) for i in range(120)]
    end = [(9999, "clock", T0 + dt.timedelta(days=400))]
    third = len(rows) // 3
    pieces = [rows[:third], rows[third : 2 * third], [(777, "hot", T0 - dt.timedelta(days=9)), *rows[2 * third :]], end]
    pieces = [rng.sample(p, len(p)) for p in pieces]
    schema = "request_id long, who string, at timestamp"
    got = streamed(spark, rows, schema, lambda s: state.rate_limited(s, "who"), tmp_path, pieces)
    assert {r.request_id: r.accepted for r in got if r.request_id != 9999} == plain_limit(rows)


def test_stream_of_runs_counts_as_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), T0 + dt.timedelta(hours=i), rng.choice([0, 0, 0, 2]), rng.choice(["fetch_failed", "parse_uncertain", "success"]), 200, rng.random() < 0.3) for i in range(60)]
    end = [(9999, "clock", T0 + dt.timedelta(days=900), 0, "success", 200, False)]
    schema = "run_id long, source string, at timestamp, events long, status string, http_status int, keywords boolean"
    got = streamed(spark, rows, schema, state.scrape_counters, tmp_path, [rng.sample(rows[:30], 30), rng.sample(rows[30:], 30), end])
    batch = transitions.scrape_counters(spark.createDataFrame(rows, schema).withColumn("is_config", F.lit(False)), ["at", "run_id"]).collect()
    last = {s: max((r.run_id, r) for r in got if r.source == s)[1] for s in "ab"}
    names = ("fetch_failures", "parse_failures", "empty_scrapes", "events_found")
    assert {s: tuple(r[n] for n in names) for s, r in last.items()} == {r.source: tuple(r[n] for n in names) for r in batch}
    assert len(got) >= len(rows)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_touches_only_what_changes(spark, tmp_path):
    path, keys = str(tmp_path / "t"), ["id"]
    t0, t1 = (F.lit(x).cast("timestamp") for x in ("2026-01-05 00:00:00", "2026-02-05 00:00:00"))
    rows = spark.range(400).selectExpr("id", "concat('t', id) AS title", "id % 3 AS size").withColumn("updated_at", t0)
    updates.create(rows, path, keys, 16)
    schema = rows.withColumn("bucket", F.lit(0)).schema
    before = files(path)
    news = spark.createDataFrame([(3, "new", 1), (3, "older", 0), (7, "t7", 1), (1000, "added", 2), (1000, "added too", 3), (None, "no key", 1)], "id long, title string, arrival long")
    said = {r.id: r.change for r in updates.upsert_into(path, news, keys, "arrival", t1, schema, 16).collect()}
    assert said == {3: "updated", 7: "unchanged", 1000: "inserted", None: "no key"}
    after = {r.id: r for r in updates.read(spark, path, schema).collect()}
    assert len(after) == 401 and (after[3].title, after[3].size, after[1000].title, after[1000].size) == ("new", 0, "added too", None)
    stamp = {i for i, r in after.items() if r.updated_at == dt.datetime(2026, 2, 5)}
    assert stamp == {3, 1000} and after[7].updated_at == dt.datetime(2026, 1, 5)
    now = files(path)
    folder = lambda f: os.path.basename(os.path.dirname(f))
    touched = {f"bucket={after[i].bucket}" for i in (3, 1000)}
    assert {f: t for f, t in before.items() if folder(f) not in touched} == {f: t for f, t in now.items() if folder(f) not in touched}
    assert len([f for f in before if folder(f) not in touched]) >= 14
    # The same again changes nothing at all.
    again = updates.upsert_into(path, news, keys, "arrival", t1, schema, 16)
    assert {r.change for r in again.collect()} == {"unchanged", "no key"} and files(path) == now
