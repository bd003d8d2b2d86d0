"""From scraped event to stored event: pre-filters, routing, the validation gate and its decisions.

Verdicts of models are an input table. Each event leaves one decision, by whose stage, outcome and
reason the metrics count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else
from calendrix.functions.text import location_verdict, malformed_title, placeholder_title
from calendrix.functions.urls import shared_platform
from calendrix.operators.transitions import cleaned_end


def prefilter_reason(title: Column, url: Column) -> Column:
    """Why an event is dropped unseen: title or URL missing, a placeholder, or code; else null."""
    return (
        F.when(or_else(title).isNull() | or_else(url).isNull(), "missing title or url")
        .when(placeholder_title(title), "invalid or placeholder title")
        .when(malformed_title(F.trim(title)), "malformed title")
    )


def validation_route(tier: Column, is_local: Column) -> Column:
    """Who judges an event: config sources are accepted or rejected where the place is known; all
    others are put to the model."""
    sure = F.coalesce(tier, F.lit("")) == "config"
    return F.when(sure & is_local, "accept").when(sure & ~is_local, "reject").otherwise("model")


def passes(valid: Column, confidence: Column, least: float = 0.6) -> Column:
    return F.coalesce(valid & (confidence >= least), F.lit(False))


def is_fresh(created_at: Column, run_started: Column, leeway_seconds: int = 5) -> Column:
    """Whether an upsert made the row: it has no creation time yet, or one of this run."""
    return created_at.isNull() | (created_at >= run_started - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(leeway_seconds)))


def image_place(venue: Column, address: Column, found: Column) -> Column:
    """struct(venue, address) after a look at the event's image, found: struct(venue, address, city,
    state); only where an event has neither venue nor address."""
    bare = or_else(venue, address).isNull()
    town = F.when(or_else(found["city"]).isNotNull(), F.coalesce(or_else(found["address"]), F.concat_ws(", ", or_else(found["city"]), or_else(found["state"]))))
    return F.struct(F.when(bare, or_else(found["venue"])).otherwise(venue).alias("venue"), F.when(bare, town).otherwise(address).alias("address"))


def decided(events: DataFrame, verdicts: DataFrame, place: Column | None = None) -> DataFrame:
    """events(id, title, url, tier, start_time, end_time, venue, address, location, description, is_free) with
    stage, outcome, reason, route, is_verified, and what is stored of an accepted one.

    verdicts(id, valid, confidence, reason, summary, is_free) is read where the route asks the
    model; an event without a verdict is rejected. place: struct(is_local, reason), by default the
    location rule over title, venue, address and location.
    """
    place = place if place is not None else location_verdict(F.col("title"), F.col("venue"), F.col("address"), F.col("location"))
    said = verdicts.select("id", F.struct("valid", "confidence", "reason", "summary", F.col("is_free").alias("free")).alias("said"))
    # Columns of their own, as the rule's word lists would be looked up anew for each use of a struct's field.
    met = events.withColumns({"_local": place["is_local"], "_why": place["reason"], "_dropped": prefilter_reason(F.col("title"), F.col("url"))})
    met = met.join(said, "id", "left").withColumn("route", validation_route(F.col("tier"), F.col("_local")))
    confidence = F.when(F.col("route") == "accept", 0.85).when(F.col("route") == "reject", 0.9).otherwise(F.col("said.confidence"))
    good = (F.col("route") == "accept") | ((F.col("route") == "model") & passes(F.col("said.valid"), F.col("said.confidence")))
    stages = [
        (F.col("_dropped").isNotNull(), "pre_filter", "skipped", F.col("_dropped")),
        (F.col("route") == "reject", "location_check", "rejected", F.col("_why")),
        (~good, "validation", "rejected", F.coalesce("said.reason", F.lit("no verdict"))),
        (F.col("start_time").isNull(), "pre_filter", "skipped", F.lit("no start time")),
    ]
    stage, outcome, reason = F.lit("upsert"), F.lit("accepted"), F.lit(None).cast("string")
    for test, *values in reversed(stages):
        stage, outcome, reason = (F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(x) for v, x in zip(values, (stage, outcome, reason)))
    return met.withColumns(
        {
            "stage": stage,
            "outcome": outcome,
            "decision_reason": reason,
            "is_verified": F.coalesce(confidence > 0.8, F.lit(False)),
            "end_time": cleaned_end(F.col("start_time"), F.col("end_time")),
            "description": or_else(F.col("said.summary"), F.col("description")),
            "is_free": F.coalesce("is_free", "said.free"),
        }
    ).drop("said", "_local", "_why", "_dropped")


def intake_tally(decisions: DataFrame) -> DataFrame:
    """decided() events(source, tier, route, outcome, stage) by source: how many the model passed and
    failed, for sources that are not config."""
    asked = decisions.where("coalesce(tier, '') <> 'config' AND decision_reason IS DISTINCT FROM 'missing title or url' AND stage <> 'location_check'")
    failed = F.count_if((F.col("stage") == "validation") & (F.col("outcome") == "rejected"))
    passed = F.count_if((F.col("stage") == "upsert") | (F.col("decision_reason") == "no start time"))
    return asked.groupBy("source").agg(passed.alias("passed"), failed.alias("failed"))


def run_counters(decisions: DataFrame) -> DataFrame:
    """One row of counters over a run's decisions(stage, outcome, route, tier)."""
    count = lambda test, name: F.count_if(test).alias(name)
    stage, outcome = F.col("stage"), F.col("outcome")
    seen = (stage != "pre_filter") | (F.col("decision_reason") == "no start time")
    return decisions.agg(
        F.count(F.lit(1)).alias("events_discovered"),
        count((stage == "upsert") | (F.col("decision_reason") == "no start time"), "events_validated"),
        count(outcome == "accepted", "events_added"),
        count((outcome == "skipped"), "events_skipped"),
        count((outcome == "rejected") & (stage == "location_check"), "rejected_by_place"),
        count((outcome == "rejected") & (stage == "validation"), "rejected_by_verdict"),
        count(seen & (F.col("route") == "model"), "model_calls"),
    )


def needs_verification(events: Column, from_config: Column, http_status: Column, page_size: Column, keywords: Column, snippet: Column, failures: Column) -> Column:
    """Whether an empty scrape of a page that looks like one of events is to be looked at: a config
    source, served and large, with event words and text, that has failed before."""
    test = (events == 0) & from_config & (http_status == 200) & (page_size > 5000) & keywords & or_else(snippet).isNotNull() & (F.coalesce(failures, F.lit(0)) >= 1)
    return F.coalesce(test, F.lit(False))


def source_acceptance(is_events: Column, is_local: Column, on_topic: Column, trust: Column) -> Column:
    """trusted from .7, review from .5; null for what is no local source of events on the topic."""
    fits = F.coalesce(is_events & is_local & on_topic, F.lit(False))
    return F.when(fits & (trust >= 0.7), "trusted").when(fits & (trust >= 0.5), "review")


def skip_results(actions: DataFrame, sources: DataFrame, events: DataFrame, as_of: Column, days: int = 28) -> DataFrame:
    """actions(pos, source_url, reason) to skip sources, with result: done, or what blocks it.

    Config sources, "covered" as a reason on a shared platform, and web-search events of the last
    days (on the source's host, and on a platform under its path) block. events(url, source, created_at).
    """
    from calendrix.functions.urls import host, path
    from calendrix.operators.transitions import skip_guard

    recent = events.where((F.col("source") == "web-search") & (F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))))
    recent = recent.select(host(F.col("url")).alias("host"), F.concat(path(F.col("url")), F.lit("/")).alias("path"))
    asked = actions.withColumns({"host": host(F.col("source_url")), "root": F.concat(F.regexp_replace(path(F.col("source_url")), "/$", ""), F.lit("/")), "shared": shared_platform(F.col("source_url"))})
    # Events are counted by host, and by each of their paths' beginnings that ends in a slash, before they meet the actions.
    by_host = recent.groupBy("host").agg(F.count(F.lit(1)).alias("on_host"))
    paths = recent.where("path IS NOT NULL").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.length("path")), lambda i: F.substring(F.col("path"), i, F.lit(1)) == "/")
    roots = paths.withColumn("root", F.explode(F.transform(ends, lambda i: F.substring(F.col("path"), F.lit(1), i))))
    by_root = roots.groupBy("host", "root").agg(F.sum("n").alias("below"))
    near = asked.select("pos", "host", "root", "shared").join(by_host, "host").join(by_root, ["host", "root"], "left")
    counts = near.groupBy("pos").agg(F.sum(F.when(F.col("shared"), F.coalesce("below", F.lit(0))).otherwise(F.col("on_host"))).alias("recent"))
    met = asked.join(sources.select(F.col("url").alias("source_url"), F.col("tier").alias("own_tier")), "source_url", "left").join(counts, "pos", "left")
    recent_n = F.coalesce("recent", F.lit(0))
    blocked = skip_guard(F.coalesce(F.col("own_tier") == "config", F.lit(False)), F.col("shared"), F.coalesce("reason", F.lit("")), recent_n)
    return met.select("pos", "source_url", F.coalesce(F.concat(F.lit("Blocked: "), blocked), F.lit("Source demoted")).alias("result"))
