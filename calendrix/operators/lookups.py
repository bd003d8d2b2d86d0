"""Joins between sources, plans, runs and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.functions.urls import host, normal_url, path, shared_platform, slug
from calendrix.operators.selection import first_of, top_of_each


def floor_rule(due: DataFrame, plan: DataFrame, as_of: Column) -> DataFrame:
    """plan(url) and the due sources (url, last_scraped) that it leaves out, with the reason."""
    days = F.datediff(as_of.cast("date"), F.col("last_scraped").cast("date"))
    text = F.when(F.col("last_scraped").isNull(), "never scraped").otherwise(F.concat(F.lit("last scraped "), days.cast("string"), F.lit(" days ago")))
    missing = due.join(plan, "url", "left_anti").select("url", text.alias("reason"))
    return plan.select("url", F.lit("planned").alias("reason")).unionByName(missing)


def split_by_plan(sources: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    return sources.join(plan.select("url"), "url", "left_semi"), sources.join(plan.select("url"), "url", "left_anti")


def unknown_organizers(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events whose organiser page has a slug that no source has. Both have url."""
    known = sources.select(slug(F.col("url")).alias("_slug")).where("_slug IS NOT NULL").distinct()
    named = events.withColumn("_slug", slug(F.col("url")))
    return named.where("_slug IS NOT NULL").join(known, "_slug", "left_anti").withColumnRenamed("_slug", "slug")


def new_urls(results: DataFrame, known: DataFrame, order: str) -> DataFrame:
    """Search results whose normalised URL is not known, the first of each by order."""
    seen = known.select(normal_url(F.col("url")).alias("normal")).distinct()
    fresh = results.withColumn("normal", normal_url(F.col("url"))).join(seen, "normal", "left_anti")
    return first_of(fresh, ["normal"], [order])


def siblings(triggers: DataFrame, sources: DataFrame, planned: DataFrame, each: int = 5, most: int = 5) -> DataFrame:
    """Other sources of a trigger's host that are neither planned nor demoted, at most `each` by
    trigger. A host offers its first each + 1 sources only (one may be the trigger itself)."""
    left = triggers.select(F.col("url").alias("trigger_url"), host(F.col("url")).alias("host"))
    right = sources.where("tier <> 'demoted'").join(planned.select("url"), "url", "left_anti").select("url", host(F.col("url")).alias("host"))
    right = top_of_each(right, ["host"], ["url"], each + 1).drop("rank")
    met = left.join(right, "host").where("url <> trigger_url")
    return top_of_each(met, ["trigger_url"], ["url"], each).orderBy("rank", "trigger_url").limit(most)


def feedback_sources(submitted: DataFrame, sources: DataFrame) -> DataFrame:
    """(submitted id, source url): a source on the submitted host or on a host below it; on a shared platform of
    the same host, with a path that the submitted one begins with."""
    left = submitted.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), shared_platform(F.col("url")).alias("shared"))
    own = host(F.col("url"))
    labels = F.split(own, r"\.")
    # A source is found by its host and by every domain that its host is below.
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    right = sources.where(own.isNotNull()).select(F.col("url").alias("source_url"), own.alias("own"), path(F.col("url")).alias("source_path"), F.explode(above).alias("host"))
    root = F.regexp_replace("source_path", "/$", "")
    fits = ~F.col("shared") | (F.col("own") == F.col("host")) & F.col("path").startswith(root)
    return left.join(right, "host").where(fits).select("id", "source_url").distinct()


def action_status(actions: DataFrame, queries: DataFrame) -> DataFrame:
    """actions(action, text, result) that create queries, with what became of the text in queries(query_text,
    is_active, ...): active, failed_to_create, or deactivated_or_recycled; skipped ones count while they are active."""
    asked = actions.where(F.col("action").isin("create_query", "create_source_query"))
    known = first_of(queries.where("is_active").withColumnRenamed("query_text", "text"), ["text"], ["text"])
    state = (
        F.when(F.col("is_active"), "active")
        .when(F.col("result").startswith("Failed"), "failed_to_create")
        .when(~F.col("result").startswith("Skipped"), "deactivated_or_recycled")
    )
    return asked.join(known, "text", "left").withColumn("status", state).where("status IS NOT NULL")


def detail_over_listing(listing: DataFrame, detail: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """listing with the fields that detail knows better."""
    named = detail.select(key, *[F.col(f).alias("_" + f) for f in fields])
    return listing.join(named, key, "left").withColumns({f: F.coalesce("_" + f, f) for f in fields}).drop(*["_" + f for f in fields])


def with_parent(children: DataFrame, parents: DataFrame, key: str, parent_key: str, fields: list[str]) -> DataFrame:
    """Each child with its parent as a struct, null without one."""
    one = parents.select(F.col(parent_key).alias(key), F.struct(*fields).alias("parent"))
    return children.join(one, key, "left")


def union_all(*streams: DataFrame) -> DataFrame:
    """Event streams in order of arrival; columns that a stream lacks are null."""
    out = None
    for n, stream in enumerate(streams):
        marked = stream.withColumn("stream", F.lit(n))
        out = marked if out is None else out.unionByName(marked, allowMissingColumns=True)
    return out
