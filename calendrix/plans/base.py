"""Input tables and fixed clocks of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_AS_OF, ORDERS_AS_OF = "2024-01-31 00:00:00", "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, with zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    stamps = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(stamps) if stamps else df


def events_now():
    return F.lit(EVENTS_AS_OF).cast("timestamp")


def orders_now():
    return F.lit(ORDERS_AS_OF).cast("timestamp")


def registry():
    """Queries, their SQL twins, and the decorator that adds to both."""
    queries, oracles = {}, {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query
