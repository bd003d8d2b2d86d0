"""Reading and writing tables: Parquet snapshots, appends, and the JSON-LD export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def append(rows: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """Appends rows and returns them; a dry run only returns them."""
    if not dry_run:
        rows.write.mode("append").parquet(path)
    return rows


def snapshot(rows: DataFrame, path: str, dry_run: bool = False) -> DataFrame:
    """A new version of a table under a path of its own: Parquet has no MERGE, and a path that is
    being read is never overwritten."""
    if not dry_run:
        rows.write.mode("error").parquet(path)
    return rows


def upcoming_events(events: DataFrame, as_of: Column) -> DataFrame:
    """The view of live events that are not over."""
    return events.where("deleted_at IS NULL").where(F.col("start_time") >= as_of)


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, which must be one: none or a second one fails the query when it is read."""
    found = rows.where(F.col(key) == value).limit(2)
    n = F.count(F.lit(1))
    best = found.agg(F.first(F.struct(*rows.columns)).alias("row"), n.alias("n"))
    wrong = F.raise_error(F.concat(F.lit(f"{key} has rows: "), F.col("n").cast("string"))).cast(best.schema["row"].dataType)
    return best.select(F.when(F.col("n") == 1, F.col("row")).otherwise(wrong).alias("row")).select("row.*")


def location_label(venue: Column, location: Column, address: Column, default: str) -> Column:
    return F.coalesce(or_else(venue, location, address), F.lit(default))


def iso_local(at: Column, zone: str) -> Column:
    """A local time with the offset that the zone has at that instant."""
    local = F.from_utc_timestamp(at, zone)
    minutes = ((F.unix_seconds(local) - F.unix_seconds(at)) / 60).cast("int")
    part = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    offset = F.concat(F.when(minutes < 0, "-").otherwise("+"), part(F.floor(F.abs(minutes) / 60)), F.lit(":"), part(F.abs(minutes) % 60))
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), offset)


def json_ld_items(events: DataFrame, zone: str, place: str) -> DataFrame:
    """(position, item): a schema.org Event as JSON for each event, in order of start.

    events(id, title, start_time, end_time, venue_name, location, address, url, description, organizer,
    is_free); place is the address of those without one. Missing values, and events without a start,
    are left out. A position is a rank within the hour and the number of events before that hour.
    """
    item = F.struct(
        F.lit("Event").alias("@type"),
        F.col("title").alias("name"),
        iso_local(F.col("start_time"), zone).alias("startDate"),
        iso_local(F.col("end_time"), zone).alias("endDate"),
        F.struct(F.lit("Place").alias("@type"), location_label(F.col("venue_name"), F.col("location"), F.col("address"), place).alias("name"), F.coalesce(or_else(F.col("address")), F.lit(place)).alias("address")).alias("location"),
        or_else(F.col("description")).alias("description"),
        F.when(or_else(F.col("organizer")).isNotNull(), F.struct(F.lit("Organization").alias("@type"), F.col("organizer").alias("name"))).alias("organizer"),
        F.col("url"),
        F.col("is_free").alias("isAccessibleForFree"),
        F.lit("https://schema.org/OfflineEventAttendanceMode").alias("eventAttendanceMode"),
    )
    hour = F.date_trunc("hour", "start_time")
    hours = events.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))  # as many rows as hours with events
    before = F.coalesce(F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = events.withColumn("hour", hour).join(F.broadcast(hours.select("hour", before.alias("before"))), "hour")
    rank = F.row_number().over(Window.partitionBy("hour").orderBy("start_time", "id"))
    return placed.select((F.col("before") + rank).alias("position"), F.to_json(item).alias("item"))


def json_ld(items: DataFrame, name: str, description: str) -> DataFrame:
    """One ItemList of json_ld_items(), for a page that shows them all: it is one string."""
    rows = items.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "item"))), lambda r: F.concat(F.lit('{"position":'), r["position"].cast("string"), F.lit(","), F.substring(r["item"], F.lit(2), F.length(r["item"])))), ",").alias("items"))
    head = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.lit(name).alias("name"), F.lit(description).alias("description")))
    return rows.select(F.concat(F.regexp_replace(head, r"\}$", ',"itemListElement":['), F.col("items"), F.lit("]}")).alias("json"))


RUN_COUNTERS = (
    "queries_run", "new_sources_found", "new_queries_generated", "sources_scraped", "events_discovered", "events_validated", "events_added", "events_updated",
    "duplicates_skipped", "errors", "claude_api_calls", "serpapi_calls", "feedback_analyzed", "feedback_sources_added", "feedback_queries_added",
)


def error_rows(steps: DataFrame) -> DataFrame:
    """(pos, error) of the steps that failed, repeats included."""
    return steps.where("error IS NOT NULL").select("pos", "error")


def run_log(steps: DataFrame, kind: str, started: Column, ended: Column) -> DataFrame:
    """One row for a run: its kind, times and whole seconds, fifteen counters summed over steps(pos, counters,
    error, source, outcome, events), every error's message in order of pos, results by source and decisions by outcome.

    A run's messages are one value of its record; error_rows() has them as rows.
    """
    seconds = F.floor((F.unix_millis(ended) - F.unix_millis(started)) / 1000 + 0.5).cast("bigint")
    counters = steps.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in RUN_COUNTERS])
    listed = F.sort_array(F.collect_list(F.struct("pos", "error")))
    messages = error_rows(steps).agg(F.transform(listed, lambda e: e["error"]).alias("error_messages"))
    results = steps.where("source IS NOT NULL").groupBy("source").agg(F.sum("events").alias("events")).agg(F.array_sort(F.collect_list(F.struct("source", "events"))).alias("source_results"))
    summary = steps.where("outcome IS NOT NULL").groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("decision_summary"))
    row = counters.crossJoin(messages).crossJoin(results).crossJoin(summary)  # one row each
    return row.select(F.lit(kind).alias("run_type"), started.alias("started_at"), ended.alias("completed_at"), seconds.alias("run_duration_seconds"), *RUN_COUNTERS, "error_messages", "source_results", "decision_summary")


def seed(spark: SparkSession, as_of: Column, rows: list[tuple]) -> DataFrame:
    """Starting rows (title, days from as_of, hour, source), with times reckoned from as_of's day."""
    made = spark.createDataFrame(rows, "title STRING, days INT, hour INT, source STRING")
    start = F.date_trunc("day", as_of) + F.make_dt_interval(F.col("days"), F.col("hour"))
    return made.select("title", start.alias("start_time"), (start + F.expr("INTERVAL 2 HOURS")).alias("end_time"), "source")
