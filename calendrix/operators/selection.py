"""Row selection, top-k and ranking. Every order ends in a unique key, so that results are fixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(events: DataFrame, include_deleted: bool = False) -> DataFrame:
    return events if include_deleted else events.where("deleted_at IS NULL")


def started_since(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Events that start after the look-back of so many days before as_of."""
    return events.where(F.col("start_time") >= as_of - F.make_dt_interval(F.lit(days)))


def starting(events: DataFrame, as_of: Column, days: int | None = None) -> DataFrame:
    """Live events(start_time, deleted_at) from as_of on; with days, up to so many later, inclusive."""
    upcoming = live(events).where(F.col("start_time") >= as_of)
    return upcoming if days is None else upcoming.where(F.col("start_time") <= as_of + F.make_dt_interval(F.lit(days)))


def faceted(
    events: DataFrame, audience: list[str] | None, levels: list[str] | None, free_only: bool = False, sources: list[str] | None = None, first: Column | None = None, last: Column | None = None
) -> DataFrame:
    """events(audience array, level, is_free, source, start_time): any of the audiences, one of the
    levels and sources, known to be free if asked, and from first to last; an empty facet does not filter."""
    tests = []
    if audience:
        tests.append(F.arrays_overlap("audience", F.array(*map(F.lit, audience))))
    if levels:
        tests.append(F.col("level").isin(levels))
    if free_only:
        tests.append(F.col("is_free").eqNullSafe(F.lit(True)))
    if sources:
        tests.append(F.col("source").isin(sources))
    tests += [F.col("start_time") >= first] if first is not None else []
    tests += [F.col("start_time") <= last] if last is not None else []
    return events.where(reduce(Column.__and__, tests)) if tests else events


def due(sources: DataFrame, as_of: Column) -> DataFrame:
    """sources(scrape_days array of 0 for Sunday to 6): those due on the day of as_of, or always."""
    return sources.where(F.col("scrape_days").isNull() | F.array_contains("scrape_days", F.dayofweek(as_of) - 1))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key; rows with a null key are left out."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    known = df.dropna(subset=keys)
    return known.withColumn("_rank", F.row_number().over(rank)).where("_rank = 1").drop("_rank")


def top_of_each(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key with their rank."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most)


def beyond_cut(df: DataFrame, order: list, kept: int) -> DataFrame:
    """All rows but the first `kept` in the order: those to be switched off.

    The first ones are a top-k of `kept` rows; the rest is an anti join on it, not a global window.
    """
    return df.join(F.broadcast(df.orderBy(*order).limit(kept).select("id")), "id", "left_anti")


def explore_exploit(queries: DataFrame, limit: int = 4, best: int = 3) -> DataFrame:
    """queries(id, priority, created_by, times_run, created_at, is_active): the best by priority, then
    the lowest not yet taken, then the newest agent query that never ran or else the second lowest.

    Every branch is a top-k of a few rows, and so is what they make.
    """
    active = queries.where("is_active")
    high = active.orderBy(F.desc("priority"), "id").limit(min(limit, best)).withColumns({"branch": F.lit(1), "at": F.lit(0)})
    low = active.orderBy(F.asc("priority"), "id").limit(2)
    low = low.withColumn("at", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("priority", "id")))
    free = low.join(F.broadcast(high.select("id")), "id", "left_anti").orderBy("at").limit(1).withColumn("branch", F.lit(2))
    taken = high.select("id").union(free.select("id"))
    fresh = active.where("created_by = 'agent' AND times_run = 0").orderBy(F.desc("created_at"), "id").limit(1)
    fresh = fresh.join(F.broadcast(taken), "id", "left_anti").withColumns({"branch": F.lit(3), "at": F.lit(0)})
    second = low.where("at = 2").join(F.broadcast(taken), "id", "left_anti").withColumn("branch", F.lit(4))
    third = fresh.unionByName(second).orderBy("branch").limit(1)
    return high.unionByName(free).unionByName(third).orderBy("branch", F.desc("priority"), "id").limit(limit).drop("at")


def productivity_order(sources: DataFrame, oldest: int = 40, most: int = 10) -> DataFrame:
    """sources(url, last_scraped, events_found, empties): of the longest unscraped ones, the never
    scraped first, then those that gave events, then by empty scrapes and age."""
    pool = sources.orderBy(F.asc_nulls_first("last_scraped"), "url").limit(oldest)
    return pool.orderBy(F.col("last_scraped").isNotNull(), F.col("events_found") <= 0, "empties", F.asc_nulls_first("last_scraped"), "url").limit(most)


def severity_rank(severity: Column, ranks: dict[str, int], default: int) -> Column:
    return F.coalesce(*[F.when(severity == s, F.lit(n)) for s, n in ranks.items()], F.lit(default))


def by_activity(pivot: DataFrame, most: int) -> DataFrame:
    total = F.col("accepted") + F.col("rejected") + F.col("duplicated") + F.col("skipped")
    return pivot.withColumn("activity", total).orderBy(F.desc("activity"), "source").limit(most)


def longest_unseen(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    """Rotation: never seen rows first, then those seen longest ago."""
    return rows.orderBy(F.asc_nulls_first(at), key).limit(most)
