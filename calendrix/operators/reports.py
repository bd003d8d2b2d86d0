"""What the monitor, reflection and dashboard read: windows, latest rows, top lists and summaries.

Every list is a top-k and every summary one aggregation; reports are assembled from them by their
reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.semantics import round_half_up
from calendrix.operators.selection import top_of_each


def rounded(x: Column) -> Column:
    return F.floor(x + 0.5).cast("bigint")


def recent(rows: DataFrame, at: str, as_of: Column, days: int, key: str, most: int | None = None) -> DataFrame:
    """Rows of the last days, newest first, at most `most` of them."""
    newest = rows.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days))).orderBy(F.desc(at), key)
    return newest.limit(most) if most else newest


def latest(rows: DataFrame, at: str, key: str, skip: int = 0, most: int = 1) -> DataFrame:
    """The newest rows after the first `skip` ones."""
    return rows.orderBy(F.desc(at), key).offset(skip).limit(most)


def latest_with(rows: DataFrame, at: str, key: str, test: Column) -> DataFrame:
    """The newest row that passes the test."""
    return rows.where(test).orderBy(F.desc(at), key).limit(1)


def latest_of_each(rows: DataFrame, keys: list[str], at: str, key: str) -> DataFrame:
    """The newest row of each group, as one aggregation."""
    fields = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.struct(at, key)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in fields])


def run_averages(runs: DataFrame, at: str, as_of: Column, latest_runs: int = 30, days: int = 7) -> DataFrame:
    """Seven averages and two sums over the runs of the last days among the latest ones; averages are
    null without any. runs: run_id, discovered, validated, added, duplicates, errors, calls, seconds."""
    top = runs.orderBy(F.col(at).desc(), F.col("run_id").desc()).limit(latest_runs)
    recent_runs = top.where(F.col(at) >= as_of - F.make_dt_interval(F.lit(days)))
    whole = [rounded(F.avg(F.coalesce(c, F.lit(0)))).alias(f"avg_{c}") for c in ("discovered", "validated", "duplicates", "calls", "seconds")]
    tenths = [round_half_up(F.avg(F.coalesce(c, F.lit(0))), 1).alias(f"avg_{c}") for c in ("added", "errors")]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in ("added", "errors")]
    return recent_runs.agg(F.count(F.lit(1)).alias("runs"), *whole, *tenths, *sums)


def scraper_health(performance: DataFrame, last: DataFrame, named: list) -> DataFrame:
    """One row: how many of the named sources work. performance(source, events) over many runs;
    last(source, status, http_status) of the latest run. A source of the latest run is healthy if
    it ever gave events and its last scrape was neither refused nor unreadable; others by events alone."""
    met = performance.where(F.col("source").isin(named)).join(last.withColumn("_seen", F.col("status").isNotNull()), "source", "left")
    bad = F.col("status").isin("fetch_failed", "parse_uncertain") | F.coalesce(F.col("http_status").isin(403, 429), F.lit(False))
    good = (F.col("events") > 0) & ~(F.coalesce("_seen", F.lit(False)) & bad)
    n, healthy = F.count(F.lit(1)), F.count_if(good)
    return met.agg(healthy.alias("healthy"), n.alias("total"), F.coalesce(rounded(F.try_divide(healthy * 100.0, n)), F.lit(0)).alias("rate"))


def enriched_performance(performance: DataFrame, last: DataFrame) -> DataFrame:
    """performance(source, ...) with what the latest run says of each source: last(source, scraper,
    status, http_status)."""
    return performance.join(last.select("source", "scraper", F.col("status").alias("last_status"), F.col("http_status").alias("last_http_status")), "source", "left")


def stale_summary(queries: DataFrame, low: float = 0.2, runs: int = 3, most: int = 5) -> DataFrame:
    """One row: how many stale queries(query_text, priority, times_run) there are, and the first names."""
    stale = queries.where((F.col("priority") < low) & (F.col("times_run") >= runs))
    names = stale.orderBy("query_text").limit(most).agg(F.array_sort(F.collect_list("query_text")).alias("names"))  # `most` rows
    return stale.agg(F.count(F.lit(1)).alias("stale")).crossJoin(names)


def decisions_by_source(decisions: DataFrame, outcomes: list[str]) -> DataFrame:
    """Counts of each outcome by source, and a map of the reasons of what was rejected or skipped."""
    refused = decisions.where(F.col("outcome").isin("rejected", "skipped") & F.col("reason").isNotNull())
    counted = refused.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))
    reasons = counted.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    counts = decisions.groupBy("source").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
    return counts.join(reasons, "source", "left")


def outcome_shares(pivot: DataFrame) -> DataFrame:
    """Whole percentages of each source: accepted, duplicated, and rejected or skipped, of all six
    outcomes; 0 without any."""
    names = ["accepted", "rejected", "duplicated", "updated", "skipped", "error"]
    total = sum((F.col(c) for c in names), F.lit(0))
    share = lambda n, name: F.coalesce(rounded(F.try_divide(n * 100.0, total)), F.lit(0)).cast("int").alias(name)
    return pivot.select("source", share(F.col("accepted"), "accept_percent"), share(F.col("duplicated"), "duplicate_percent"), share(F.col("rejected") + F.col("skipped"), "reject_percent"))


def stage_bars(stages: DataFrame) -> DataFrame:
    """stages(stage, n) with the share of the largest, as a percentage."""
    top = stages.agg(F.greatest(F.max("n"), F.lit(1)).alias("_top"))  # one row
    return stages.crossJoin(F.broadcast(top)).select("stage", "n", round_half_up(F.col("n") * 100.0 / F.col("_top"), 1).alias("width"))


def findings_by(reports: DataFrame, field: str) -> DataFrame:
    """How many elements of the array findings have each value of a field, by report, counted within
    the array; reports(id, findings array of structs)."""
    values = F.array_distinct(F.transform("findings", lambda f: f[field]))
    each = reports.select("id", "findings", F.explode(values).alias(field))
    return each.select("id", field, F.size(F.filter("findings", lambda f: f[field].eqNullSafe(F.col(field)))).alias("n"))


def cost_panel(runs: DataFrame, at: str, as_of: Column, rate: float = 0.015) -> DataFrame:
    """runs(run_id, calls, searches, added): sums over 7 and 30 days, cost by event, daily average
    cost and the cost of the last run, in one pass."""
    out = []
    for days in (7, 30):
        inside = F.col(at) > as_of - F.make_dt_interval(F.lit(days))
        total = {c: F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)) for c in ("calls", "searches", "added")}
        out += [v.alias(f"{c}_{days}") for c, v in total.items()]
        out += [F.round(total["calls"] * rate, 4).alias(f"cost_{days}"), F.round(F.coalesce(F.try_divide(total["calls"] * rate, total["added"]), F.lit(0.0)), 4).alias(f"cost_per_event_{days}")]
    month = F.coalesce(F.sum(F.when(F.col(at) > as_of - F.make_dt_interval(F.lit(30)), F.col("calls"))), F.lit(0))
    last = F.max_by("calls", F.struct(at, "run_id"))
    return runs.agg(*out, F.round(month * rate / 30, 4).alias("daily_cost"), F.round(F.coalesce(last, F.lit(0)) * rate, 4).alias("last_run_cost"))


def deviations(results: DataFrame, high: int = 10, most: int = 10) -> DataFrame:
    """One row over results(url, planned, events, error, expected): sources observed, triggers fired,
    adjustments made (at most `most`) and predictions that were missed by more than half."""
    planned = results.where("planned")
    trigger = F.col("error") | (F.col("events") == 0) | (F.col("events") >= high)
    off = (F.col("events") > F.col("expected") * 1.5) | (F.col("events") < F.col("expected") * 0.5)
    fired = F.count_if(trigger)
    return planned.agg(F.count(F.lit(1)).alias("observed"), fired.alias("triggers"), F.least(fired, F.lit(most)).alias("adjustments"), F.count_if(off).alias("deviations"), F.count_if("error").alias("errors"))


def stale_reports(reports: DataFrame, key: str, at: str, unique: str, least: int = 5, prefix: int = 100) -> DataFrame:
    """(key, grade, streak, alike, stale): how many of the newest reports(grade, summary) agree with
    the latest in grade, and in the beginning of the summary; stale if both reach the least."""
    ranked = top_of_each(reports.select(key, at, unique, "grade", F.substring(F.coalesce("summary", F.lit("")), 1, prefix).alias("head")), [key], [F.desc(at), unique], 1 << 30)
    first = ranked.where("rank = 1").select(key, F.col("grade").alias("_grade"), F.col("head").alias("_head"))
    met = ranked.join(first, key)
    run = lambda same: F.coalesce(F.min(F.when(~same, F.col("rank"))), F.count(F.lit(1)) + 1) - 1
    out = met.groupBy(key, F.col("_grade").alias("grade")).agg(run(F.col("grade").eqNullSafe(F.col("_grade"))).alias("streak"), run(F.col("head") == F.col("_head")).alias("alike"))
    return out.withColumn("stale", (F.col("streak") >= least) & (F.col("alike") >= least))


def scout_summary(probes: DataFrame) -> DataFrame:
    """One row over probes(events), null where nothing was probed."""
    return probes.agg(F.count(F.lit(1)).alias("findings"), F.count("events").alias("probed"), F.count_if(F.col("events") > 0).alias("viable"), F.count_if(F.col("events") == 0).alias("empty"))


def item_stats(items: DataFrame) -> DataFrame:
    """One row over items(is_resolved, severity)."""
    open_ = ~F.col("is_resolved")
    return items.agg(F.count_if(open_).alias("unresolved"), F.count_if("is_resolved").alias("resolved"), F.count_if(open_ & (F.col("severity") == "critical")).alias("critical"))


def merged_diagnostics(parts: DataFrame) -> DataFrame:
    """parts(source, place, http_status, page_size, attempts array, events) by source: the first
    part's status, summed sizes, all attempts in order, and the first status that gave events."""
    entry = F.struct("place", "http_status", "page_size", "attempts", "events")
    rows = F.array_sort(F.collect_list(entry))  # a handful of parts by source
    grouped = parts.groupBy("source").agg(rows.alias("rows"))
    gave = F.filter("rows", lambda r: r["events"] > 0)
    return grouped.select(
        "source",
        F.get("rows", F.lit(0))["http_status"].alias("http_status"),
        F.aggregate("rows", F.lit(0).cast("bigint"), lambda n, r: n + F.coalesce(r["page_size"], F.lit(0))).alias("page_size"),
        F.flatten(F.transform("rows", lambda r: r["attempts"])).alias("attempts"),
        F.coalesce(F.get(gave, F.lit(0))["place"], F.element_at("rows", -1)["place"]).alias("strategy"),
    )


def reflection_window(experiments: DataFrame, reports: DataFrame, plans: DataFrame, runs: DataFrame, audits: DataFrame, as_of: Column, days: int = 30) -> dict[str, DataFrame]:
    """The five reads of a reflection, by name: each (id, created_at, ...), newest first."""
    take = lambda df, most: recent(df, "created_at", as_of, days, "id", most)
    return {
        "experiments": take(experiments.where("status = 'evaluated'"), None),
        "reports": take(reports, 15),
        "plans": take(plans.where("status = 'completed'"), 15),
        "runs": take(runs, 30),
        "audits": take(audits, 10),
    }


def compact_runs(runs: DataFrame, at: str, key: str, most: int = 10, errors: int = 3) -> DataFrame:
    """The latest runs as a report shows them, with their first error messages."""
    top = runs.orderBy(F.desc(at), key).limit(most)
    return top.withColumn("error_messages", F.slice("error_messages", 1, errors))
