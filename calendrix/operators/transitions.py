"""State changes as pure functions of (state, input): each returns the new state, nothing is written.

A table is updated by writing the returned snapshot under a new name, or in place, partition by
partition, by sources.updates. Inputs that could hold a key
twice are reduced to one row first, as no key is enforced.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calendrix.functions.semantics import or_else
from calendrix.operators.selection import first_of


def upsert(state: DataFrame, rows: DataFrame, keys: list[str], order: str, now: Column | None = None) -> DataFrame:
    """state with rows merged in: a row replaces the one with its keys, others are added.

    Of rows with equal keys the last by order counts. A null key never meets another.
    """
    last = first_of(rows, keys, [F.desc(order)]).drop(order)
    unkeyed = rows.where(~_all_known(keys)).drop(order)
    if now is not None:
        last, unkeyed = last.withColumn("updated_at", now), unkeyed.withColumn("updated_at", now)
    kept = state.join(last.select(*keys), keys, "left_anti")
    return kept.unionByName(last, allowMissingColumns=True).unionByName(unkeyed, allowMissingColumns=True)


def _all_known(keys: list[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def insert_absent(state: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """state and those rows whose key it does not have, the first by order of each."""
    return state.unionByName(first_of(rows, [key], [order]).drop(order).join(state, key, "left_anti"), allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, changes): names of the fields where both sides have a value and differ."""
    met = old.alias("o").join(new.alias("n"), key)
    named = [F.when(or_else(F.col(f"o.{f}").cast("string")) != or_else(F.col(f"n.{f}").cast("string")), F.lit(f)) for f in fields]
    return met.select(key, F.array_compact(F.array(*named)).alias("changes"))


def cleaned_end(start: Column, end: Column) -> Column:
    """An end that is not after its start is dropped."""
    return F.when(end > start, end)


def scrape_counters(runs: DataFrame, order: list[str], demote_at: int = 3) -> DataFrame:
    """State of each source after all its runs, in order.

    runs(source, events, status, http_status, keywords, is_config). Events reset the three counters;
    fetch_failed counts as a fetch failure; parse_uncertain, or keywords on a page that was served,
    as a parse failure; else the scrape was empty. Counters count since the last run with events.
    """
    window = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failed = F.when(F.col("events") > 0, "found").when(F.col("status") == "fetch_failed", "fetch")
    failed = failed.when((F.col("status") == "parse_uncertain") | (F.col("keywords") & (F.col("http_status") == 200)), "parse").otherwise("empty")
    marked = runs.withColumn("kind", failed).withColumn("island", F.count_if(F.col("kind") == "found").over(window))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("fetch", "parse", "empty")]
    islands = marked.groupBy("source", "island").agg(*counts, F.bool_or("is_config").alias("is_config"), F.sum("events").alias("found"))
    state = islands.groupBy("source").agg(F.max_by(F.struct("fetch", "parse", "empty"), "island").alias("s"), F.bool_or("is_config").alias("is_config"), F.sum("found").alias("events_found"))
    return state.select(
        "source", F.col("s.fetch").alias("fetch_failures"), F.col("s.parse").alias("parse_failures"), F.col("s.empty").alias("empty_scrapes"), "events_found",
        (F.col("s.parse") >= demote_at).alias("escalate"), ((F.col("s.empty") >= demote_at) & ~F.col("is_config")).alias("demote"),
    )


def validated(sources: DataFrame, tally: DataFrame) -> DataFrame:
    """sources(source, tier, passed, failed) with tallies added; probation that fails mostly is demoted."""
    sums = tally.groupBy("source").agg(F.sum("passed").alias("_p"), F.sum("failed").alias("_f"))
    met = sources.join(sums, "source", "left")
    good, bad = F.col("passed") + F.coalesce("_p", F.lit(0)), F.col("failed") + F.coalesce("_f", F.lit(0))
    poor = (F.col("tier") == "probation") & (good + bad >= 5) & (good < (good + bad) * 0.5)
    return met.withColumns({"tier": F.when(poor, "demoted").otherwise(F.col("tier")), "passed": good, "failed": bad}).drop("_p", "_f")


def run_queries(queries: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """queries(id, times_run, sources_found, priority, last_success) after results(id, found)."""
    sums = results.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.sum("found").alias("_found"))
    met = queries.join(sums, "id", "left")
    hit = F.coalesce(F.col("_found") > 0, F.lit(False))
    return met.withColumns({
        "times_run": F.col("times_run") + F.coalesce("_n", F.lit(0)), "sources_found": F.col("sources_found") + F.coalesce("_found", F.lit(0)),
        "priority": F.when(hit, 1.0).otherwise(F.col("priority")), "last_success": F.when(hit, now).otherwise(F.col("last_success")),
    }).drop("_n", "_found")


def to_deactivate(times_run: Column, found: Column, priority: Column) -> Column:
    return (times_run > 0) & ((priority < 0.05) | ((times_run >= 2) & (found == 0) & (priority < 0.3)))


def backfilled_tier(url: Column, tier: Column, config_urls: list[str]) -> Column:
    """Find pages are demoted, listed sources are config, trusted and missing tiers go on probation."""
    known = url.isin(config_urls) if config_urls else F.lit(False)
    return F.when(known, "config").when(url.like("%meetup.com/find/%"), "demoted").when(tier.isNull() | (tier == "trusted"), "probation").otherwise(tier)


def skip_guard(is_config: Column, platform: Column, reason: Column, recent_events: Column) -> Column:
    """Why a source may not be skipped; null if it may."""
    return (
        F.when(is_config, "config source")
        .when(platform & F.contains(F.lower(reason), F.lit("covered")), "shared platform")
        .when(recent_events >= 1, "recent web-search events")
    )


def repair_status(status: Column, attempts: Column, resolved: Column, most: int = 3) -> Column:
    """Repairs that keep failing are frozen."""
    return F.when(~resolved & status.isin("pending", "failed") & (attempts >= most), "rolled_back").otherwise(status)


def request_pieces(requests: DataFrame, key: str, at: str, hours: int) -> DataFrame:
    """(key, day, piece) of the days on which each key has requests: a new piece begins after a pause of the
    hours or more, where a limiter's state is empty. Only a row for each key's day is ordered."""
    day = F.date_trunc("day", at)
    days = requests.where(F.col(at).isNotNull()).groupBy(key, day.alias("day")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    order = Window.partitionBy(key).orderBy("day")
    since = F.unix_micros("first") - F.unix_micros(F.lag("last").over(order))
    begins = days.withColumn("begins", F.coalesce(since >= hours * 3_600_000_000, F.lit(False)).cast("int"))
    return begins.select(key, "day", F.sum("begins").over(order).alias("piece"))


def rate_limited(requests: DataFrame, key: str, most: int = 3, hours: int = 24) -> DataFrame:
    """requests(request_id, key, at) with accepted: at most `most` accepted ones in any window of
    the hours. Refused ones use no quota, so that decisions follow one another.

    Each decision rests on those before it, but not on what lies the hours or more before: a key's requests
    are cut where it paused that long (24 or more; shorter hours are cut as 24 are), and its pieces are read side
    by side, each in order from sorted partitions with the last accepted times as state. A key that
    never pauses is one piece, read in a stream by one core: its decisions are one chain.
    Requests without a time are refused; a null key is a key.
    """
    width = hours * 3600 * 1_000_000

    def run(batches):
        now, kept = None, []
        for pdf in batches:
            out = []
            for name, piece, at in zip(pdf["who"], pdf["piece"], pdf["micros"]):
                if (name, piece) != now:
                    now, kept = (name, piece), []
                kept = [x for x in kept if at - x < width]
                out.append(len(kept) < most)
                if out[-1]:
                    kept.append(at)
            yield pd.DataFrame({"request_id": pdf["request_id"], "accepted": out})

    # A text, so that a null key is told from all others.
    rows = requests.select("request_id", F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("who"), "at")
    untimed = rows.where("at IS NULL").select("request_id", F.lit(False).alias("accepted"))
    rows = rows.where("at IS NOT NULL")
    pieces = request_pieces(rows, "who", "at", max(hours, 24))
    met = rows.withColumn("day", F.date_trunc("day", "at")).join(pieces, ["who", "day"]).select("request_id", "who", "piece", F.unix_micros("at").alias("micros"))
    kind = requests.schema["request_id"].dataType.simpleString()
    dealt = met.repartition("who", "piece").sortWithinPartitions("who", "piece", "micros", "request_id")
    return dealt.mapInPandas(run, f"request_id {kind}, accepted boolean").unionByName(untimed)


def observer_triggers(results: DataFrame, high: int = 10) -> DataFrame:
    """(source, trigger) of planned sources: parser_error, zero_from_expected and high_yield."""
    e = F.col("events")
    found = F.array_compact(F.array(F.when(F.col("error"), "parser_error"), F.when(~F.col("error") & (e == 0), "zero_from_expected"), F.when(e >= high, "high_yield")))
    return results.where("planned").select("source", F.explode(found).alias("trigger"))
