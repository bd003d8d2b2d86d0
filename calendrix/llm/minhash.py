"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each word shingle is hashed once. The hash's low bits name one of BINS bins, and a bin keeps its
least hash. An empty bin takes the value of the first non-empty bin in its own fixed random order
(optimal densification: Shrivastava, 2017), so all bins are comparable however short the text. Of
each bin the fingerprint stores 8 bits, eight bins to a long. Two texts of likeness J agree in a
bin with probability J + (1 - J)/256, which likeness() inverts.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calendrix.llm.common import ascii_lower, durable, fresh, whole_text, written

WORDS, BINS = 5, 128
#: Ranges of documents, whose least keys are sent to every executor: 24 bytes each for numeric ids.
MOST_RANGES = 200_000
#: Ranges that one partition is cut into: there are at most MOST_RANGES / PARTED partitions.
PARTED = 100
#: Ranges that a task works off, on average.
RANGES_A_TASK = 8
LOWEST = 0x0101010101010101


def probe_order(bins: int = BINS, seed: int = 1) -> list[list[int]]:
    """For each bin, all bins in the order in which it tries them when it is empty."""
    rng = random.Random(seed)
    return [rng.sample(range(bins), bins) for _ in range(bins)]


def with_fingerprint(df: DataFrame, text: str, name: str, words: int = WORDS, bins: int = BINS) -> DataFrame:
    """df with the fingerprint of column text as column name: an array of bins/8 longs.

    Words are divided by ASCII white space, A-Z lower-cased. A text of fewer words than a shingle
    is one shingle; null texts and texts without words get an empty array.
    """
    kept = [c for c in df.columns if c.lower() != name.lower()]
    w_, h_, b_ = fresh(df, "words"), fresh(df, "hashes"), fresh(df, "bytes")
    width, first_probes = 64 - (bins.bit_length() - 1), 16
    bin_of = lambda h: F.shiftrightunsigned(h, width)
    orders = probe_order(bins)
    array = lambda rows: F.expr("array(%s)" % ", ".join(f"array({', '.join(map(str, row))})" for row in rows))
    split = F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+")
    df = df.withColumn(w_, F.transform(F.filter(split, lambda w: w != ""), lambda w: F.xxhash64(w)))
    # get() past the end gives null, which the hash passes over: a short text is one shingle.
    shingle = lambda i: F.xxhash64(*[F.get(w_, i + k) for k in range(words)])
    starts = F.sequence(F.lit(0), F.greatest(F.size(w_) - words, F.lit(0)))
    df = df.withColumn(h_, F.sort_array(F.when(F.size(w_) > 0, F.transform(starts, shingle)).otherwise(F.array().cast("array<bigint>"))))
    # In sorted order the first hash of each bin is its least.
    df = df.withColumn(h_, F.filter(h_, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(h_, i - 1)))))
    # One long for each bin, in order: the bin, whether it has a hash, eight bits of the hash.
    full = F.transform(h_, lambda h: bin_of(h) * 512 + 256 + h.bitwiseAND(F.lit(255)))
    empty = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")), F.transform(h_, bin_of))
    df = df.withColumn(b_, F.sort_array(F.concat(full, F.transform(empty, lambda b: b * 512))))
    held = lambda j: F.get(b_, j).bitwiseAND(F.lit(256)) != 0
    probe = lambda rows, i: F.get(F.filter(F.get(array(rows), i), held), F.lit(0))
    source = lambda i: F.coalesce(probe([r[:first_probes] for r in orders], i), probe(orders, i))
    df = df.withColumn(b_, F.transform(b_, lambda b, i: F.when(b.bitwiseAND(F.lit(256)) != 0, b).otherwise(F.get(b_, source(i))).bitwiseAND(F.lit(255))))
    lane = lambda g, k: F.shiftleft(F.get(b_, g * 8 + k), 8 * k)
    packed = F.transform(F.sequence(F.lit(0), F.lit(bins // 8 - 1)), lambda g: reduce(Column.bitwiseOR, [lane(g, k) for k in range(8)]))
    return df.withColumn(name, F.when(F.size(h_) > 0, packed).otherwise(F.array().cast("array<bigint>"))).select(*kept, name)


def likeness(a: str, b: str, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of two fingerprints, without the bias of chance agreement.

    Two texts without words are alike (1.0); one without words and one with are not (0.0).
    """
    differ = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x, k: x.bitwiseOR(F.shiftrightunsigned(x, k))
    # The lowest bit of each byte, set exactly if the byte is not zero.
    marks = lambda x: fold(fold(fold(x, 4), 2), 1).bitwiseAND(F.lit(LOWEST))
    unlike = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda n, x: n + F.bit_count(marks(x)))
    agree = 1 - unlike / F.lit(bins)
    chance = 1 / 256
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), (agree - chance) / (1 - chance)))
    )


def hexed(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def _cuts(keys: DataFrame, ranges: int) -> DataFrame:
    """One row: the greatest key(doc_id, digest) of each of about `ranges` ranges of keys of equal
    size, in descending order; blocks: those keys in blocks of about the root of their number.

    Keys are sorted in one partition for each PARTED ranges, of which every so-manieth is taken.
    """
    order = [F.desc("doc_id"), F.desc("digest")]
    ranged = keys.repartitionByRange(-(-ranges // PARTED), *order).sortWithinPartitions(*order)
    # The low 33 bits number the rows of a partition.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    size = max(1, -(-keys.count() // ranges))
    heads = ranged.select(F.struct("doc_id", "digest").alias("key"), place.alias("place")).where(F.col("place") % size == 0)
    listed = heads.agg(F.sort_array(F.collect_set("key"), asc=False).alias("cuts"))  # one for each range or partition
    n = F.ceil(F.sqrt(F.size("cuts"))).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.size("cuts") - 1, n), lambda at: F.slice("cuts", at + 1, n))
    return durable(listed.select(n.alias("width"), F.size("cuts").alias("n_cuts"), blocks.alias("blocks")))


def with_next(docs: DataFrame, columns: list[str], per_range: int = 1000, most: int = MOST_RANGES) -> DataFrame:
    """docs(doc_id, text, ...) with next_<column> for each of columns, from the next document.

    The order is by descending doc_id, rows of one doc_id by descending text hash, and the first
    row follows the last. Rows are cut into ranges of about per_range rows, at most `most` of them,
    at keys that Spark's range partitioning gives, so that they are of one size whatever the ids
    are; rows meet their followers within a range, to which the row after its last one is sent as
    well. Rows that repeat both doc_id and text are in one range. Rows with a null doc_id have no
    next document. Columns named next_<column> are replaced.
    """
    docs = docs.drop(*["next_" + c for c in columns])
    missing = [F.lit(None).cast(docs.schema[c].dataType).alias("next_" + c) for c in columns]
    unnamed = docs.where("doc_id IS NULL").select("*", *missing)
    named = docs.where("doc_id IS NOT NULL")
    digest = F.xxhash64(whole_text(docs))
    keys = written(named.select("doc_id", digest.alias("digest")))
    n = keys.count()
    if not n:
        return unnamed
    width, n_cuts, blocks, own, place, sent = (fresh(docs, x) for x in ("width", "n_cuts", "blocks", "own_key", "place", "sent"))
    ranges = max(1, min(-(-n // per_range), most))
    cuts = _cuts(keys, ranges).toDF(width, n_cuts, blocks)
    rows = named.crossJoin(F.broadcast(cuts))  # one row of at most `most` keys
    rows = rows.withColumn(own, F.struct(named["doc_id"].alias("doc_id"), digest.alias("digest")))
    # How many heads are not below the key: first of the blocks, then within the last such block.
    above = lambda heads: F.size(F.filter(heads, lambda head: head >= F.col(own))) - 1
    block = above(F.transform(blocks, lambda b: b[0]))
    rows = rows.withColumn(place, block)
    within = above(F.get(blocks, F.col(place)))
    is_head = F.get(F.get(blocks, F.col(place)), within) == F.col(own)
    at = F.col(place) * F.col(width) + within
    here, before = F.struct(at.alias("at"), F.lit(0).alias("sent")), F.struct(F.pmod(at - 1, F.col(n_cuts)).alias("at"), F.lit(1).alias("sent"))
    rows = rows.withColumn(place, F.explode(F.when(is_head, F.array(here, before)).otherwise(F.array(here))))
    rows = rows.select(*docs.columns, own, F.col(place)["at"].alias(place), F.col(place)["sent"].alias(sent))
    # As many tasks as the ranges need: their number grows with the rows, their size does not.
    rows = rows.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-ranges // RANGES_A_TASK)), place)
    order = Window.partitionBy(place).orderBy(sent, F.desc(own))
    led = rows.withColumns({"next_" + c: F.lead(c).over(order) for c in columns}).where(F.col(sent) == 0)
    return led.drop(own, place, sent).unionByName(unnamed)


def compare_with_next(docs: DataFrame, words: int = WORDS, bins: int = BINS) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, one row for each row of docs.

    The edited text has the last floor(n_chars/3) code points replaced by as many of the start of
    the next document (see with_next), or by all of it if it is shorter. Returns doc_id, n_chars,
    edited_text, fingerprint, edited_fingerprint (arrays of longs), near_edited and near_next: the
    likeness of the fingerprint to those of the edited text and of the next document. Null texts
    count as empty, and so does the next document of a null doc_id. Other columns are not read.
    """
    base = with_fingerprint(docs.select("doc_id", whole_text(docs).alias("text")), "text", "fingerprint", words, bins)
    led = with_next(base, ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    after = F.coalesce("next_fingerprint", F.array().cast("array<bigint>"))
    made = led.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited_text"), "fingerprint", after.alias("after"))
    made = with_fingerprint(made, "edited_text", "edited_fingerprint", words, bins)
    near = {"near_edited": likeness("fingerprint", "edited_fingerprint", bins), "near_next": likeness("fingerprint", "after", bins)}
    return made.withColumns(near).drop("after")
