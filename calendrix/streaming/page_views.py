"""Page views and decisions as streams: an addition to the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendrix.functions.text import ai_crawler, visitor_type


def classified(views: DataFrame) -> DataFrame:
    """views(page, user_agent, created_at) with visitor_type and is_ai."""
    return views.withColumns({"visitor_type": visitor_type(F.col("user_agent")), "is_ai": ai_crawler(F.col("user_agent"))})


def daily_visitors(views: DataFrame, late: str = "1 day") -> DataFrame:
    """Views by day, page and visitor type of the distinct (day, agent) pairs, with late rows up to
    the watermark; works on batches and on streams."""
    marked = classified(views).withWatermark("created_at", late).withColumn("day", F.to_date("created_at"))
    once = marked.dropDuplicatesWithinWatermark(["day", "page", "user_agent"]) if views.isStreaming else marked.dropDuplicates(["day", "page", "user_agent"])
    return once.groupBy(F.window("created_at", "1 day").alias("day"), "page", "visitor_type").agg(F.count(F.lit(1)).alias("visitors"))
