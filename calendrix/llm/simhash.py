"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit SimHash of its word shingles. Two fingerprints link at `radius` or fewer
differing bits. Bit i of the fingerprint is given a non-zero vector f(i) of radius+1 bits; table v
(all non-zero v of radius+1 bits) keeps the bits with an odd inner product of f(i) and v. The
vectors of any `radius` bits span less than the whole space, so some v is orthogonal to all of
them, and in its table the two fingerprints agree: no link is missed (Pagh, 2016).

Equal fingerprints are one node from the start, however many documents have them. A table's bucket
of up to BUCKET different fingerprints is searched in one task and gives at most one link per
member. Fingerprints of larger buckets go by midpoints instead: two of them link exactly if some
word lies within half the radius of both, so each is listed under all words that near and shares
them; that grows in proportion to the fingerprints, not to their pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calendrix.llm.common import durable, fresh, sliced, texts_of, whole_text
from calendrix.llm.components import connected_components

WORDS, RADIUS, SEED, BUCKET = 4, 4, 42, 4096
#: Shares of buckets for each shuffle partition, at least, and rows of a share, about.
SHARES, SHARE_ROWS = 4, 1 << 16
#: Shingles of one text hashed at a time, so that a very long text needs no more memory.
CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits, as signed integers."""
    n = (1 << (radius + 1)) - 1
    return [_signed(sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2)) for v in range(1, n + 1)]


def simhash(text: str, words: int = WORDS) -> int:
    """Majority bits of the XXH64 values of all shingles, repeats included; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts, ends = [0, *ends[:-1]], ends[words - 1 :] or ends[-1:]
    ones, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, CHUNK):
        part = [digest(line[s : e - 1], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint bigint) of each row; null and empty texts have fingerprint 0."""

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in sliced([batch]):
                values = np.fromiter((simhash(t, words) for t in texts_of(part)), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    # Arrow, not pandas, which takes a number column with nulls as floats and so rounds large ids.
    return docs.select("doc_id", whole_text(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, fingerprint bigint")


def _forest(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members of one bucket as all their links would."""
    left, links = members, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            near = np.bitwise_count(left ^ x) <= radius
            links += [(x, y) for y in left[near]]
            todo += list(left[near])
            left = left[~near]
    return links


def _search(radius: int):
    """For all rows (t, k, x) of some whole buckets, in any order."""

    def run(rows: pa.Table) -> pa.Table:
        t, k, x = (rows[c].to_numpy() for c in ("t", "k", "x"))
        order = np.lexsort((k, t))
        t, k, x = t[order], k[order], x[order].view(np.uint64)
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        found = [link for part in np.split(x, cuts) for link in _forest(part, radius)]
        found = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _by_midpoints(nodes: DataFrame, radius: int) -> DataFrame:
    """Links of nodes(x) that give the same components as all pairs within the radius."""
    near, far = radius // 2, (radius + 1) // 2
    ball = [
        F.struct(F.lit(_signed(sum(1 << i for i in bits))).alias("flip"), F.lit(n <= near).alias("is_near"))
        for n in range(far + 1)
        for bits in combinations(range(64), n)
    ]
    listed = nodes.withColumn("p", F.explode(F.array(*ball))).select(
        "x", F.col("x").bitwiseXOR(F.col("p.flip")).alias("z"), F.col("p.is_near").alias("is_near")
    )
    heads = listed.where("is_near").groupBy("z").agg(F.min("x").alias("head"))
    return listed.join(heads, "z").where("x != head").select(F.col("x").alias("a"), F.col("head").alias("b")).distinct()


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of different fingerprints of nodes(x), all within the radius or joined by such;
    their components are those of all pairs within the radius."""
    tables = F.array(
        *[F.struct(F.lit(t).cast("short").alias("t"), F.col("x").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(covering_masks(radius))]
    )
    keyed = nodes.withColumn("e", F.explode(tables)).select("x", "e.t", "e.k")
    counts = durable(
        keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("a"), F.max("x").alias("b")).where("n > 1")
    )
    twos = counts.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    small = counts.where((F.col("n") > 2) & (F.col("n") <= bucket))
    # Grouped, not dealt and sorted: Spark leaves out a repartition by the keys of the join before it, and then may join
    # by a broadcast, which reads a bucket's rows in several tasks. A share is many buckets, as each group has its cost.
    rows = small.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shares = max(SHARES * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SHARE_ROWS))
    some = keyed.join(small.select("t", "k"), ["t", "k"]).withColumn("share", F.pmod(F.xxhash64("t", "k"), F.lit(shares)))
    found = twos.union(some.groupBy("share").applyInArrow(_search(radius), "a bigint, b bigint"))
    large = counts.where(F.col("n") > bucket).select("t", "k")
    if not large.isEmpty():
        found = found.union(_by_midpoints(keyed.join(large, ["t", "k"]).select("x").distinct(), radius))
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for each row of docs(doc_id, text).

    component_id is the least doc_id among the documents reachable by links. Null and empty texts
    share fingerprint 0 and link like any other; repeated rows come back as often as they came in;
    a null doc_id never names a component unless all its members are null. Other columns of docs
    are not read. An empty table gives an empty result.
    """
    prints = durable(fingerprints(docs, words))
    nodes = durable(prints.groupBy(F.col("fingerprint").alias("x")).agg(F.min("doc_id").alias("first_id")))
    joined = connected_components(links(nodes.select("x"), radius, bucket))
    placed = nodes.join(joined, nodes.x == joined.node, "left").select("x", "first_id", F.coalesce("component", "x").alias("root"))
    roots = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = placed.join(roots, "root").select(F.col("x").alias("fingerprint"), "component_id")
    return prints.join(named, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_per_group(docs: DataFrame, **settings) -> DataFrame:
    """docs without those that another document of their component stands for.

    The document with the least doc_id of each component stays. Rows that repeat both doc_id and
    text are one document, of which one row stays; rows that share a doc_id but not their text are
    all kept if that doc_id is their component's least. Without any doc_id in a component, all stay.
    """
    groups = durable(near_duplicates(docs, **settings))
    out = groups.where("doc_id != component_id").select(F.col("doc_id").alias("out_id")).distinct()
    kept = docs.join(out, docs["doc_id"] == out["out_id"], "left_anti")
    again = groups.where("doc_id is not null").groupBy(F.col("doc_id").alias("out_id")).count().where("count > 1").select("out_id")
    if again.isEmpty():
        return kept
    n = fresh(docs, "copy_no")
    order = Window.partitionBy("doc_id", "text").orderBy(F.lit(0))
    repeated = kept.join(again, kept["doc_id"] == again["out_id"], "left_semi").withColumn(n, F.row_number().over(order))
    return kept.join(again, kept["doc_id"] == again["out_id"], "left_anti").unionByName(repeated.where(F.col(n) == 1).drop(n))
