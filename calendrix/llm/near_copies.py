"""Near copies by exact likeness of shingle sets: SimHash first, MinHash bands beyond its radius.

The likeness of two texts is the Jaccard likeness of their sets of word shingles; a link is a pair of
SIMILAR or more, verified on the whole sets. Equal sets are one node from the start, however many
documents have them. Candidates come in rounds, and nodes that earlier rounds have joined are not
compared again:

1. SimHash's links (op1's fingerprints and covering tables), which join most near copies, each verified;
2. MinHash bands, as a 64-bit SimHash cannot search at 0.8, where texts differ in about 10 bits: texts
   that agree in all ROWS minima of one of BANDS bands. A pair of likeness s is among them with
   probability 1-(1-s^ROWS)^BANDS: 0.99993 at 0.8, more above.

A bucket of up to BUCKET nodes is searched in one task. A larger one is dealt into parts, each with the
bucket's least node beside it, which joins what is alike to it; then one node for each group found so far is
searched in the same way. Buckets that are still of more than one group, such as those of a template that
thousands of texts fill in, are not left at that: their nodes get FINE_BANDS bands of FINE_ROWS
minima (0.99998 at 0.8), which part what a template alone has in common. Buckets of those that are large and of several
groups even then are compared block by block, everything outside the largest group with
everything; no pair within the largest group is. So what is found does not depend on the sizes of buckets.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from calendrix.llm.common import durable, fresh, sliced, whole_text, written
from calendrix.llm.components import connected_components
from calendrix.llm.simhash import links as simhash_links
from calendrix.llm.simhash import simhash

WORDS, SIMILAR, BANDS, ROWS, BUCKET, SEED = 5, 0.8, 24, 5, 512, 42
FINE_BANDS, FINE_ROWS = 100, 10
#: Rows of two numbers up to which a list is sent to where the texts are; more meet them by a shuffle.
SENT_ROWS = 1_000_000
#: Shingles that a part of a bucket has on average, at most.
PART = 1 << 22
#: Shingles of one text whose minima are taken at a time.
CHUNK = 1 << 13


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles; of all words if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(parts), xxhash.xxh64_intdigest
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts, ends = [0, *ends[:-1]], ends[words - 1 :] or ends[-1:]
    return np.unique(np.fromiter((digest(line[s : e - 1], SEED) for s, e in zip(starts, ends)), np.uint64, len(ends)))


@cache
def _mixers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (2, n, 1), np.uint64) | np.uint64(1)


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    factors, shifts = _mixers(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        mixed = (shingles[at : at + CHUNK] ^ shifts) * factors
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(32))).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(bands, rows)], np.uint64).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([np.zeros(0, np.int64), *[x.view(np.int64) for x in arrays]])
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, arrays)]).astype(np.int32), flat)


def banded(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, digest of the text, node, size, print, bands) of each row; node stands for the shingle
    set of that size, print is the SimHash."""

    def run(batches):
        for batch in sliced(batches):
            texts = batch["text"].to_pylist()
            sets = [shingle_set(t, words) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64)
            prints = np.fromiter(map(simhash, texts), np.uint64, len(texts))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            columns = [batch["doc_id"], batch["digest"], *map(pa.array, (nodes.view(np.int64), sizes, prints.view(np.int64))), _lists([band_keys(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "node", "size", "print", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole_text(docs)
    return docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text")).mapInArrow(
        run, f"doc_id {kind}, digest bigint, node bigint, size bigint, print bigint, bands array<bigint>"
    )


def shingled(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, shingles) of texts(node, text)."""

    def run(batches):
        for batch in sliced(batches):
            sets = _lists([shingle_set(t, words) for t in batch["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["node"], sets], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingles array<bigint>")


def fine_bands(sets: DataFrame) -> DataFrame:
    """(t, k, node, size) of sets(node, shingles): the bands of FINE_ROWS minima."""

    def run(batches):
        for batch in batches:
            flat, offsets = batch["shingles"].values.to_numpy().view(np.uint64), batch["shingles"].offsets.to_numpy()
            keys = [band_keys(flat[a:b], FINE_BANDS, FINE_ROWS) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(np.diff(offsets).astype(np.int64)), _lists(keys)], ["node", "size", "bands"])

    keys = sets.select("node", "shingles").mapInArrow(run, "node bigint, size bigint, bands array<bigint>")
    return keys.select(F.posexplode("bands").alias("t", "k"), "node", "size")


def _alike(own: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets are alike to one."""
    sizes = np.array([len(y) for y in others])
    able = np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own))
    near = np.zeros(len(others), bool)
    if able.any() and len(own):
        flat = np.concatenate([y for y, a in zip(others, able) if a])
        met = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(met.astype(np.int64), np.cumsum(sizes[able]) - sizes[able])
        near[able] = common / (len(own) + sizes[able] - common) >= similarity
    return near


def _forest(nodes: np.ndarray, groups: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the groups of one task's members as all their links would. Two members of side 1 are
    not compared: they are of one group, or compared elsewhere."""
    links, left = [], np.arange(len(nodes))
    while len(left):
        todo = list(left[groups[left] == groups[left[0]]])
        left = left[groups[left] != groups[left[0]]]
        while todo and len(left):
            x = todo.pop()
            able = left[(sides[left] == 0) | (sides[x] == 0)]
            near = able[_alike(sets[x], [sets[y] for y in able], similarity)] if len(able) else able
            # One link for each group met, whose members all follow.
            _, first = np.unique(groups[near], return_index=True)
            links += [(nodes[x], nodes[y]) for y in near[first]]
            met = np.isin(groups[left], groups[near])
            todo += list(left[met])
            left = left[~met]
    return links


def _search(similarity: float):
    """For rows sorted by task; a task may span batches."""

    def emit(nodes, groups, sides, sets):
        found = _forest(np.array(nodes, np.int64), np.array(groups, np.int64), np.array(sides, np.int8), sets, similarity)
        found = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        at, held = None, ([], [], [], [])
        for batch in batches:
            flat, offsets = batch["shingles"].values.to_numpy().view(np.uint64), batch["shingles"].offsets.to_numpy()
            columns = [batch[c].to_pylist() for c in ("t", "k", "part", "other", "node", "grp", "side")]
            for i, (*key, node, group, side) in enumerate(zip(*columns)):
                if key != at:
                    if len(held[0]) > 1:
                        yield emit(*held)
                    at, held = key, ([], [], [], [])
                for column, value in zip(held, (node, group, side, flat[offsets[i] : offsets[i + 1]].copy())):
                    column.append(value)
        if len(held[0]) > 1:
            yield emit(*held)

    return run


class Links:
    """The links found so far, and the groups that they make of the nodes."""

    def __init__(self, sets: DataFrame, similarity: float, bucket: int):
        self.sets, self.similarity, self.bucket = sets, similarity, bucket
        self.links: DataFrame | None = None
        self.groups: DataFrame | None = None  # components of all links, once they are asked for

    def grouped(self, members: DataFrame, roughly: bool = False) -> DataFrame:
        """members(node, ...) with grp, the least node of its group; roughly, the least of itself and what it is
        linked with, which tells most groups in one step and joins none that are apart."""
        if self.links is None:
            return members.withColumn("grp", F.col("node"))
        if roughly and self.groups is None:
            both = self.links.union(self.links.select("b", "a"))
            labels = both.groupBy(F.col("a").alias("own")).agg(F.least("a", F.min("b")).alias("component"))
        else:
            if self.groups is None:
                self.groups = durable(connected_components(self.links))
            labels = self.groups.select(F.col("node").alias("own"), "component")
        return members.join(labels, members.node == labels.own, "left").withColumn("grp", F.coalesce("component", "node")).drop("own", "component")

    def open_buckets(self, members: DataFrame) -> DataFrame:
        """(t, k, n, head, parts) of the buckets of members(t, k, node, size, grp) of more than one group,
        one for each set of members."""
        counts = members.groupBy("t", "k").agg(
            F.count(F.lit(1)).alias("n"), F.min("node").alias("head"), F.min("grp").alias("least"), F.max("grp").alias("most"), F.sum("size").alias("size"),
            F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
        )
        parts = F.ceil(F.greatest(F.col("n") / self.bucket, F.col("size") / PART)).alias("parts")
        once = counts.where("least < most").groupBy("n", "head", "size", "x", "y").agg(F.min(F.struct("t", "k")).alias("e"))
        return once.select("e.t", "e.k", "n", "head", parts)

    def compare(self, tasks: DataFrame) -> None:
        """Searches tasks(t, k, part, other, node, grp, side) for links."""
        met = tasks.join(self.sets, "node").repartition("t", "k", "part", "other").sortWithinPartitions("t", "k", "part", "other")
        found = durable(met.select("t", "k", "part", "other", "node", "grp", "side", "shingles").mapInArrow(_search(self.similarity), "a bigint, b bigint"))
        if not found.isEmpty():
            self.links = found if self.links is None else self.links.union(found)
            self.groups = None

    def verify(self, pairs: DataFrame) -> None:
        """Takes the pairs(a, b) that are alike."""
        ends = F.explode(F.array("a", "b")).alias("node")
        zero = F.lit(0)
        self.compare(pairs.select(F.lit(-1).alias("t"), F.xxhash64("a", "b").alias("k"), F.col("a").alias("part"), F.col("b").alias("other"), ends).select("*", F.col("node").alias("grp"), zero.alias("side")))

    def deal(self, members: DataFrame, found: DataFrame) -> None:
        """Searches the buckets: one task, or parts that each have the bucket's head beside them."""
        every = F.sequence(F.lit(0), F.col("parts").cast("int") - 1)
        part = F.when((F.col("node") == F.col("head")) & (F.col("parts") > 1), every).otherwise(F.array(F.pmod(F.xxhash64("node"), "parts").cast("int")))
        met = members.join(found, ["t", "k"])
        self.compare(met.select("t", "k", F.explode(part).alias("part"), F.lit(0).alias("other"), "node", "grp", F.lit(0).alias("side")))

    def search(self, members: DataFrame) -> DataFrame:
        """Searches members(t, k, node, size); the members of large buckets that are still of several groups."""
        now = durable(self.grouped(members, roughly=True))
        found = durable(self.open_buckets(now))
        if found.isEmpty():
            return now.limit(0)
        self.deal(now, found)
        large = found.where("parts > 1").select("t", "k")
        if large.isEmpty():
            return now.limit(0)
        # One node for each group of a large bucket.
        rest = durable(self.grouped(now.join(large, ["t", "k"]).drop("grp")))
        heads = rest.groupBy("t", "k", "grp").agg(F.min(F.struct("node", "size")).alias("e")).select("t", "k", "e.node", "e.size", "grp")
        found = durable(self.open_buckets(heads))
        if found.isEmpty():
            return now.limit(0)
        self.deal(heads, found)
        rest = self.grouped(rest.drop("grp"))
        return durable(rest.join(self.open_buckets(rest).where("parts > 1").select("t", "k"), ["t", "k"]))

    def compare_blocks(self, members: DataFrame) -> None:
        """Compares all members of buckets(t, k, node, size, grp) outside the bucket's largest group with all."""
        sizes = members.groupBy("t", "k", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        whole = sizes.groupBy("t", "k").agg(
            F.max_by("grp", F.struct("n", "grp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "grp", "size")).alias("m")
        )
        blocks = lambda n, size: F.ceil(F.greatest(n / self.bucket, size / PART, F.lit(1))).cast("int")
        main, rest = blocks(F.col("m.n"), F.col("m.size")), blocks(F.col("n") - F.col("m.n"), F.col("size") - F.col("m.size"))
        met = members.join(durable(whole.select("t", "k", "main", main.alias("parts"), rest.alias("others"))), ["t", "k"])
        deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        pair = lambda part, other: F.struct(part.alias("part"), other.alias("other"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        # Blocks of the rest have numbers from 0, those of the largest group -1, -2 and so on. Two blocks meet once.
        within = F.transform(upto("others"), lambda o: pair(F.least(o, deal("others")), F.greatest(o, deal("others"))))
        beside = F.transform(upto("parts"), lambda p: pair(-1 - p, deal("others")))
        is_main = F.col("grp") == F.col("main")
        tasks = F.when(is_main, F.transform(upto("others"), lambda o: pair(-1 - deal("parts"), o))).otherwise(F.concat(within, beside))
        met = met.withColumn("e", F.explode(tasks)).select("t", "k", "e.part", "e.other", "node", "grp", is_main.cast("int").alias("side"))
        self.compare(met)


def _beside_texts(rows: DataFrame) -> DataFrame:
    """rows, of few numbers each and kept already, for a join with whole texts: sent to them if they are no more than SENT_ROWS."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILAR, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, digest, root) of each row of docs(doc_id, text): rows of one root are joined by links.

    Texts without words are of one group; null is the empty text.
    """
    rows = written(banded(docs, words))
    nodes = rows.groupBy("node").agg(
        F.min(F.struct("doc_id", "digest")).alias("e"), F.any_value("bands").alias("bands"), F.any_value("size").alias("size"), F.min("print").alias("print")
    )
    nodes = durable(nodes)
    prints = nodes.where("size > 0").groupBy(F.col("print").alias("x")).agg(F.min("node").alias("head"))
    prints = durable(prints)
    links = simhash_links(prints.select("x"))
    a, b = prints.toDF("a", "a_head"), prints.toDF("b", "b_head")
    apart = links.join(a, "a").join(b, "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    same = nodes.join(prints, nodes.print == prints.x).where("node != head AND size > 0").select(F.col("head").alias("a"), F.col("node").alias("b"))
    hashed = durable(apart.union(same))
    keyed = nodes.select(F.posexplode("bands").alias("t", "k"), "node", "size")
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k")
    shared = durable(keyed.join(durable(shared), ["t", "k"]))
    # Whole sets are made anew, and only of the texts that have something to be compared with.
    met = shared.select("node").union(hashed.select("a")).union(hashed.select("b")).distinct()
    wanted = met.join(nodes, "node").select("node", F.col("e.doc_id").alias("own_id"), F.col("e.digest").alias("own_digest"))
    texts = docs.select("doc_id", whole_text(docs).alias("text")).withColumn("digest", F.xxhash64("text"))
    texts = texts.join(_beside_texts(durable(wanted)), texts["doc_id"].eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    sets = written(shingled(texts.select("node", "text").dropDuplicates(["node"]), words))
    found = Links(sets, similarity, bucket)
    found.verify(hashed)
    left = found.search(shared)
    if not left.isEmpty():
        # Large buckets of several groups are looked at more finely.
        found.compare_blocks(found.search(written(fine_bands(sets.join(left.select("node").distinct(), "node")))))
    return found.grouped(rows.select("doc_id", "digest", "node")).select("doc_id", "digest", F.col("grp").alias("root"))


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each group.

    The row with the least doc_id stays (null comes last), and of those the one with the least text
    digest: decisions hold for a text and not for all rows of its doc_id. Rows that repeat both are
    one document, of which one row stays.
    """
    rows = durable(groups(docs, **settings))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    # Written first, so that both sides of the join are plain shuffles, of which Spark splits a large group's.
    met = durable(rows.groupBy("root", "doc_id", "digest").count()).join(durable(best), "root")
    h, n, own_id, own_digest = (fresh(docs, x) for x in ("digest", "copy_no", "o_id", "o_digest"))
    met = met.select(F.col("doc_id").alias(own_id), F.col("digest").alias(own_digest), "count", (order != F.col("best")).alias("out"))
    met = durable(met.where("out or count > 1"))
    marked = docs.withColumn(h, F.xxhash64(whole_text(docs)))
    same = marked["doc_id"].eqNullSafe(F.col(own_id)) & (F.col(h) == F.col(own_digest))
    kept = marked.join(_beside_texts(durable(met.where("out"))), same, "left_anti")
    again = met.where("not out").select(own_id, own_digest)
    if again.isEmpty():
        return kept.drop(h)
    repeated = kept.join(again, same, "left_semi").withColumn(n, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(F.lit(0))))
    return kept.join(again, same, "left_anti").unionByName(repeated.where(F.col(n) == 1).drop(n)).drop(h)
