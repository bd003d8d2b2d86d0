"""Coverage, health, cost and decision-log metrics. Each is one aggregation over its input, or an
aggregation after a bounded top-k; none collects rows on the driver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calendrix.functions.semantics import call_cost, pass_rate, round_half_up


def counts_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def tier_counts(sources: DataFrame, tier: str, default: str = "probation") -> DataFrame:
    return sources.groupBy(F.coalesce(F.nullif(F.col(tier), F.lit("")), F.lit(default)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


def weekly_counts(events: DataFrame, at: str) -> DataFrame:
    return events.groupBy(F.to_date(F.date_trunc("week", F.col(at))).alias("week")).agg(F.count(F.lit(1)).alias("n"))


def daily_sum(runs: DataFrame, at: str, value: Column) -> DataFrame:
    return runs.groupBy(F.to_date(at).alias("day")).agg(F.sum(value).alias("added"))


def chart_totals(daily: DataFrame) -> DataFrame:
    """Total, and the average by day to one decimal."""
    total = F.coalesce(F.sum("added"), F.lit(0))
    return daily.agg(total.alias("total"), round_half_up(F.try_divide(total, F.count(F.lit(1))), 1).alias("per_day"))


def source_performance(results: DataFrame, runs: DataFrame, run_id: str, started: str, last: int = 14) -> DataFrame:
    """(source, events, runs, zero_runs) over the results of the latest runs.

    results(run id, source, events) are joined with a top-k of runs, of at most `last` rows.
    """
    latest = runs.orderBy(F.col(started).desc_nulls_last(), F.col(run_id).desc()).limit(last).select(run_id)
    return results.join(F.broadcast(latest), run_id, "left_semi").groupBy("source").agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("runs"), F.count_if(F.col("events") == 0).alias("zero_runs")
    )


def failure_groups(sources: DataFrame, kind: str, least: int = 2) -> DataFrame:
    """Kinds of failing sources with at least `least` of them."""
    return sources.groupBy(F.col(kind).alias("kind")).agg(F.count_distinct("source").alias("sources")).where(F.col("sources") >= least)


def calendar_gaps(events: DataFrame, at: str, first: dt.date, days: int) -> DataFrame:
    """(day) of a window of days without any event."""
    spark = events.sparkSession
    calendar = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"))
    taken = events.where((F.to_date(at) >= F.lit(first)) & (F.to_date(at) < F.date_add(F.lit(first), days))).select(F.to_date(at).alias("day")).distinct()
    return calendar.join(taken, "day", "left_anti")


def health_rate(results: DataFrame, healthy: Column) -> DataFrame:
    n = F.count(F.lit(1))
    return results.agg(F.count_if(healthy).alias("healthy"), n.alias("total"), F.floor(F.try_divide(F.count_if(healthy) * 100.0, n) + 0.5).cast("int").alias("rate"))


def window_averages(runs: DataFrame, at: str, as_of: Column, latest: int = 30, days: int = 7) -> DataFrame:
    """Averages of discovered, added and errors over the runs of the last days among the latest runs;
    null without any. runs: run_id, discovered, added, errors."""
    top = runs.orderBy(F.col(at).desc(), F.col("run_id").desc()).limit(latest)
    recent = top.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    return recent.agg(
        F.count(F.lit(1)).alias("runs"),
        F.floor(F.avg("discovered") + 0.5).cast("bigint").alias("avg_discovered"),
        round_half_up(F.avg("added"), 1).alias("avg_added"),
        round_half_up(F.avg("errors"), 1).alias("avg_errors"),
        F.sum("added").alias("sum_added"),
    )


def stale_queries(queries: DataFrame, low: float = 0.2, runs: int = 3, most: int = 5) -> DataFrame:
    """The first stale queries by name. queries: query_text, priority, times_run."""
    stale = queries.where((F.col("priority") < low) & (F.col("times_run") >= runs))
    return stale.orderBy("query_text").limit(most)


def outcome_pivot(decisions: DataFrame, outcomes: list[str]) -> DataFrame:
    """A column of counts for each outcome, and all decisions, by source."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in outcomes]
    return decisions.groupBy("source").agg(*counts, F.count(F.lit(1)).alias("decisions"))


def top_reasons(decisions: DataFrame, outcomes: list[str], most: int = 10) -> DataFrame:
    """The commonest reasons of some outcomes: how often, and of how many sources."""
    kept = decisions.where(F.col("outcome").isin(outcomes) & F.col("reason").isNotNull())
    grouped = kept.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))
    return grouped.orderBy(F.desc("n"), "reason").limit(most)


def top_duplicate_sources(decisions: DataFrame, outcome: str, most: int = 10) -> DataFrame:
    grouped = counts_by(decisions.where(F.col("outcome") == outcome), "stage", "source")
    return grouped.orderBy(F.desc("n"), "stage", "source").limit(most)


def cost_efficiency(decisions: DataFrame, rate: float = 0.001) -> DataFrame:
    """Calls, acceptances and the cost of one acceptance to four decimals, by source."""
    calls, accepted = F.count_if("called"), F.count_if(F.col("outcome") == "accepted")
    return decisions.groupBy("source").agg(
        calls.alias("calls"), accepted.alias("accepted"), round_half_up(F.try_divide(calls * rate, accepted), 4).alias("cost_per_event")
    )


def run_totals(runs: DataFrame) -> DataFrame:
    """runs: added, errors. Number, successes, success percentage, total and average added."""
    n, good = F.count(F.lit(1)), F.count_if(F.col("errors") == 0)
    return runs.agg(
        n.alias("runs"),
        good.alias("successes"),
        round_half_up(F.try_divide(good * 100.0, n), 1).alias("success_percent"),
        F.sum("added").alias("added"),
        round_half_up(F.avg("added"), 1).alias("avg_added"),
    )


def cost_windows(runs: DataFrame, at: str, as_of: Column, rate: float = 0.015) -> DataFrame:
    """runs: calls, added. Sums over 7 and 30 days in one pass, with costs."""
    out = []
    for days in (7, 30):
        inside = F.col(at) >= as_of - F.make_dt_interval(F.lit(days))
        calls = F.coalesce(F.sum(F.when(inside, F.col("calls"))), F.lit(0))
        added = F.coalesce(F.sum(F.when(inside, F.col("added"))), F.lit(0))
        cost = F.round(calls * rate, 4)
        out += [calls.alias(f"calls_{days}"), added.alias(f"added_{days}"), cost.alias(f"cost_{days}")]
        out += [F.round(F.coalesce(F.try_divide(calls * rate, added), F.lit(0.0)), 4).alias(f"cost_per_event_{days}")]
    return runs.agg(*out)


def error_stats(runs: DataFrame, at: str, as_of: Column) -> DataFrame:
    """runs: errors (array of messages). Errors, runs with any, error-free percentage, errors of 7 days."""
    n, size = F.count(F.lit(1)), F.coalesce(F.size("errors"), F.lit(0))
    bad = F.count_if(size > 0)
    free = F.coalesce(round_half_up(F.try_divide((n - bad) * 100.0, n), 1), F.lit(100.0))
    week = F.sum(F.when(F.col(at) >= as_of - F.make_dt_interval(F.lit(7)), size).otherwise(0))
    return runs.agg(F.sum(size).alias("errors"), bad.alias("runs_with_errors"), free.alias("error_free_percent"), week.alias("errors_7_days"))


def decision_totals(decisions: DataFrame) -> DataFrame:
    """Totals of the four main outcomes and the acceptance percentage."""
    names = ["accepted", "rejected", "duplicated", "skipped"]
    each = {o: F.count_if(F.col("outcome") == o) for o in names}
    total = sum(each.values(), F.lit(0))
    return decisions.agg(*[c.alias(o) for o, c in each.items()], F.floor(F.try_divide(each["accepted"] * 100.0, total) + 0.5).cast("int").alias("accept_percent"))


def confidence_summary(experiments: DataFrame, at: str, as_of: Column, days: int = 14) -> DataFrame:
    """experiments: hit (nullable), delta. Undecided ones count as no hit."""
    recent = experiments.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    return hit_summary(recent)


def hit_summary(experiments: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return experiments.agg(
        n.alias("evaluated"),
        round_half_up(F.try_divide(F.count_if(F.col("hit")) * 1.0, n), 2).alias("hit_rate"),
        round_half_up(F.avg("delta"), 3).alias("avg_delta"),
    )


def spend_on(runs: DataFrame, at: str, day: Column) -> DataFrame:
    """Cost of the calls of one UTC day."""
    return runs.where(F.to_date(at) == day).agg(F.round(F.coalesce(F.sum(call_cost(F.col("calls"))), F.lit(0.0)), 4).alias("spent"))


def budget_cap(calls: DataFrame, key: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """calls with spent (running sum by key) and affordable (spent within the cap) and remaining.

    Exact where the calls of a key cost alike: then no call fits after one that does not.
    """
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.round(F.sum(cost).over(window), 6)
    return calls.withColumns({"spent": spent, "affordable": spent <= cap, "remaining": F.greatest(F.lit(0.0), F.round(cap - spent, 6))})


def unique_visitors(views: DataFrame, page: str, agent: str, at: str) -> DataFrame:
    """Distinct (day, agent) by page; rows with a null agent count as one."""
    return views.select(page, F.to_date(at).alias("day"), agent).distinct().groupBy(page).agg(F.count(F.lit(1)).alias("visitors"))


def validation_tally(outcomes: DataFrame) -> DataFrame:
    """outcomes: source, passed (boolean). Tallies and the pass rate by source."""
    good, bad = F.count_if("passed"), F.count_if(~F.col("passed"))
    return outcomes.groupBy("source").agg(good.alias("passed"), bad.alias("failed"), pass_rate(good, bad).alias("pass_rate"))


def with_issues(tally: DataFrame, empties: Column) -> DataFrame:
    return tally.where((empties >= 2) | ((F.col("failed") > F.col("passed")) & (F.col("failed") >= 3)))


def struggling(tally: DataFrame, empties: Column, most: int = 3) -> DataFrame:
    total = F.col("passed") + F.col("failed")
    rate = F.coalesce(F.try_divide(F.col("passed") * 1.0, total), F.lit(1.0))
    return tally.where(((total >= 5) & (rate < 0.5)) | (empties >= 3)).orderBy(rate, "source").limit(most)


def organizer_rollup(findings: DataFrame, samples: int = 3) -> DataFrame:
    """findings: slug, name, title, position. Count, first name and first titles by slug.

    Samples are picked by rank before they are gathered, so that a large group stays bounded.
    """
    order = Window.partitionBy("slug").orderBy("position")
    ranked = findings.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= samples)
    first = ranked.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("_rank", "title", "name"))).alias("_first"))
    shown = first.select("slug", F.get("_first", F.lit(0))["name"].alias("name"), F.transform("_first", lambda s: s["title"]).alias("titles"))
    return counts_by(findings, "slug", name="events").join(shown, "slug")


def scout_findings(rollup: DataFrame) -> DataFrame:
    """Confidence .8 from two events on, else .5, and the rank value."""
    confidence = F.when(F.col("events") >= 2, 0.8).otherwise(0.5)
    return rollup.withColumns({"confidence": confidence, "value": F.round(confidence * F.greatest(F.col("events"), F.lit(1)), 4)})


def grade_streak(reports: DataFrame, key: str, order: list[str], grade: str, least: int = 5) -> DataFrame:
    """(key, grade, streak) of the newest reports that agree without a break; stale from `least` on."""
    newest = Window.partitionBy(key).orderBy(*order)
    named = reports.select(key, grade, F.row_number().over(newest).alias("rn"), F.first(grade).over(newest).alias("latest"))
    breaks = F.min(F.when(~F.col(grade).eqNullSafe(F.col("latest")), F.col("rn")))
    grouped = named.groupBy(key, F.col("latest").alias("grade")).agg((F.coalesce(breaks, F.count(F.lit(1)) + 1) - 1).alias("streak"))
    return grouped.withColumn("stale", F.col("streak") >= least)


def heartbeat(repairs: DataFrame, at: str, as_of: Column, fixable: Column, hours: int = 48) -> DataFrame:
    """Whether nothing was repaired for too long although something could be: one row."""
    age = F.try_divide(F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max(at).cast("timestamp")), F.lit(3_600_000_000))
    waiting = F.count_if(fixable)
    return repairs.agg(F.floor(age).cast("bigint").alias("hours"), waiting.alias("fixable"), F.coalesce((age > hours) & (waiting >= 1), F.lit(False)).alias("alarm"))


def grade_letter(health: Column, error_rate: Column, contributing: Column, added: Column) -> Column:
    return (
        F.when((health >= 80) & (error_rate < 5) & (contributing >= 4) & (added > 0), "A")
        .when((health >= 60) & (error_rate < 10) & (contributing >= 3), "B")
        .when(health >= 40, "C")
        .otherwise("D")
    )
