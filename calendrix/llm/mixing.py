"""Mixes sources to target weights by Poisson replication, in DataFrame functions only.

A source's documents are wanted rate = (its weight / all weights) * wanted size / its own size
times on average. Each document draws its number of copies from a Poisson distribution of that mean,
by inverting the distribution function at a uniform number hashed from the seed and its doc_id;
a rate above PIECE is split into equal parts whose draws are added, which has the same
distribution. Copies are then put in a random order that depends on the seed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import BROADCAST_ROWS, durable, fresh, whole_text

SEED, PIECE, TERMS, SALTS = 17, 16, 80, 32


def size_of(df: DataFrame) -> Column:
    """Code points of the text, one at least, so that no source is without size."""
    return F.greatest(F.char_length(whole_text(df)), F.lit(1)).cast("bigint")


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """(source, weight, size, rate) of each source of docs; a null source is a source too."""
    sizes = docs.select("source", size_of(docs).alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    weight = F.lit(float(default_weight))
    for name, value in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(value))).otherwise(weight)
    sizes = durable(sizes.withColumn("weight", weight))
    totals = sizes.agg(F.sum("weight").alias("all_weights"), F.sum("size").alias("all_sizes"))  # one row
    rate = F.try_divide("weight", "all_weights") * (F.lit(float(epochs)) * F.col("all_sizes")) / F.col("size")
    return sizes.crossJoin(F.broadcast(totals)).select("source", "weight", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _distribution(rate: Column) -> Column:
    """P(X <= k) for k from 0 to TERMS - 1."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def add(state: Column, k: Column) -> Column:
        p = state["p"] * rate / k
        c = state["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(state["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, add, lambda s: s["all"])


def _hashed(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def uniform(*parts) -> Column:
    """52 bits of a hash of the parts, as a number from 0 up to 1."""
    return F.conv(F.substring(_hashed(*parts), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: dict[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs(doc_id, text, source, ...) replicated to the weights, in a random global order.

    All columns of docs, copy_no (from 1) and mix_key, by whose order the rows are shuffled: rows
    go to partitions at random and are sorted by it there. epochs is the wanted size as a multiple
    of all documents' code points. Sources without a weight have default_weight; a weight of 0
    drops a source. Rows that repeat a doc_id draw alike; null texts have size 1; columns
    named copy_no or mix_key are replaced. An empty table gives an empty result.
    """
    docs = docs.drop("copy_no", "mix_key")
    own_source, pieces, table, salt, their_salt, n = (fresh(docs, x) for x in ("own_source", "pieces", "table", "salt", "their_salt", "copies"))
    rates = source_rates(docs, weights, default_weight, epochs)
    rates = rates.withColumn(pieces, F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    rates = durable(rates.select(F.col("source").alias(own_source), pieces, _distribution(F.col("rate") / F.col(pieces)).alias(table)))
    same = docs["source"].eqNullSafe(F.col(own_source))
    if rates.count() <= broadcast_rows:
        met = docs.join(F.broadcast(rates), same, "left")
    else:  # too many sources to send everywhere: hot ones are spread over salts
        salted = rates.withColumn(their_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs_s = docs.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        met = docs_s.join(salted, same & (F.col(salt) == F.col(their_salt)), "left")
    doc, key = F.col("doc_id"), F.lit(seed)
    # One number for each piece, hashed once; its draw is how much of the table lies at or below it.
    numbers = F.transform(F.sequence(F.lit(1), F.col(pieces)), lambda piece: uniform(key, doc, piece))
    draws = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter(table, lambda c: c <= u)))
    copies = met.withColumn(n, draws).where(F.col(n) > 0).withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn("mix_key", _hashed(key, doc, F.col("copy_no"), F.lit("order")))
    return keyed.select(*docs.columns, "copy_no", "mix_key").repartition("mix_key").sortWithinPartitions("mix_key")
