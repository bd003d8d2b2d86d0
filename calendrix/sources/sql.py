"""What users call from SQL: table functions on the page views and a view of the events to come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendrix.functions.text import AI_CRAWLERS

FUNCTIONS = ("unique_visitor_count", "ai_crawler_count")


def register(spark: SparkSession, views: DataFrame, events: DataFrame, as_of: Column) -> None:
    """Makes the session know, until it ends or they are registered anew:

    * unique_visitor_count(page, type): a table of one row, visitors: the distinct (day, agent) of the page's
      views of that visitor type; a null agent is one;
    * ai_crawler_count(page): a table of one row, visits: the page's views by agents that name an AI crawler;
    * upcoming_events: the events(start_time, ...) from as_of on.

    views: page, visitor_type, user_agent, created_at. A page or type without views counts 0.
    """
    views.select("page", "visitor_type", "user_agent", "created_at").createOrReplaceTempView("page_views")
    events.where(F.col("start_time") >= as_of).createOrReplaceTempView("upcoming_events")
    crawlers = "|".join(AI_CRAWLERS)
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION unique_visitor_count(p_page STRING, p_type STRING) RETURNS TABLE (visitors BIGINT)
        RETURN SELECT count(*) FROM (SELECT DISTINCT to_date(created_at) AS day, user_agent FROM page_views WHERE page = p_page AND visitor_type = p_type)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION ai_crawler_count(p_page STRING) RETURNS TABLE (visits BIGINT)
        RETURN SELECT count(*) FROM page_views WHERE page = p_page AND visitor_type = 'bot' AND user_agent RLIKE '(?i){crawlers}'""")
