"""Upserts into a partitioned Parquet table that rewrite the partitions they touch and no others.

The table is cut by a hash of its keys, kept in the column `bucket`, so that the rows of a key are in one
partition whatever they hold. An upsert compares the incoming rows with the partitions that they fall
into, writes those that change by dynamic partition overwrite, and returns what happened to each row. A
partition without a change keeps its files. Spark commits all partitions of a write at once at its end, from a
staging folder; a job that fails before that leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendrix.operators.kept import checkpointed
from calendrix.operators.selection import first_of

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> None:
    """Writes rows, which have updated_at, as a table for upsert_into()."""
    cut = rows.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket")
    cut.write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def upsert_into(path: str, rows: DataFrame, keys: list[str], order: str, now: Column, schema, buckets: int = BUCKETS) -> DataFrame:
    """Merges rows into the table at path, whose columns are schema (with updated_at and bucket); returns
    (keys..., change): inserted, updated or unchanged.

    Of rows with equal keys the last by order counts; rows with a null key are left out, and said to be
    "no key". Columns that rows lack stay as they are, or null where the row is new. A row that
    brings nothing new is unchanged and keeps its updated_at, all others get now.
    """
    spark = rows.sparkSession
    checkpointed(spark)
    fields = [c for c in rows.columns if c not in (*keys, order, "updated_at", "bucket")]
    last = first_of(rows, keys, [F.desc(order)]).select(*keys, *fields).withColumn("bucket", bucket_of(keys, buckets))
    told = F.lit(True).alias("_is")
    old = read(spark, path, schema)
    met = last.select(*keys, "bucket", *[F.col(f).alias("_" + f) for f in fields], told).join(old.withColumn("_was", F.lit(True)), [*keys, "bucket"], "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col("_" + f).eqNullSafe(F.col(f))
    change = F.when(F.col("_was").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    changes = met.select(*keys, "bucket", change.alias("change")).checkpoint()
    touched = changes.where("change != 'unchanged'").select("bucket").distinct()
    numbers = [r.bucket for r in touched.collect()]  # at most `buckets`
    if numbers:
        part = old.where(F.col("bucket").isin(numbers))
        news = last.where(F.col("bucket").isin(numbers)).select(*keys, *[F.col(f).alias("_" + f) for f in fields], told)
        whole = part.drop("bucket").withColumn("_was", F.lit(True)).join(news, keys, "full")
        differs = F.lit(False)
        for f in fields:
            differs = differs | ~F.col("_" + f).eqNullSafe(F.col(f))
        takes = F.col("_is").isNotNull() & (F.col("_was").isNull() | differs)
        values = {f: F.when(takes, F.col("_" + f)).otherwise(F.col(f)) for f in fields}
        values["updated_at"] = F.when(takes, now).otherwise(F.col("updated_at"))
        merged = whole.withColumns(values).withColumn("bucket", bucket_of(keys, buckets)).select([f.name for f in schema])
        merged = merged.checkpoint()  # read in full before its own files are replaced
        writer = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(path)
    unknown = rows.where(~_known(keys)).select(*keys, F.lit("no key").alias("change"))
    return changes.drop("bucket").unionByName(unknown)


def _known(keys: list[str]) -> Column:
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known
