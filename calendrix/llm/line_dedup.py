"""Removes lines that many documents share, with levelled sorted runs of line hashes.

A run is a table of (line hash, number of documents), bucketed and sorted by the hash and written
once. Each new batch writes its own run, meets the runs before it by merge joins that neither
shuffle nor sort them, loses its lines that they know to be frequent by an anti join, and adds its
run to level 0. When a level holds FAN_IN runs they are merged into one run of the next level, so
n batches leave about FAN_IN*log(n) runs and each count is rewritten log(n) times. A line that
becomes frequent only later goes in a last pass over what the batches have left. DataFrame
functions only.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calendrix.llm.common import ASCII_SPACE, ascii_lower, bucketed, discard, whole_text, written

MIN_DOCS, MIN_CHARS, FAN_IN, BATCHES = 10, 1, 3, 4


def _stripped(line: Column) -> Column:
    """The line without white space at its ends; trim() reads all of a line, so it is used only
    where there is some."""
    bare = reduce(Column.__or__, [line.startswith(c) | line.endswith(c) for c in ASCII_SPACE])
    return F.when(bare, F.trim(line, F.lit(ASCII_SPACE))).otherwise(line)


def line_keys(lines: Column) -> Column:
    """Each line of an array without white space at its ends, A-Z lower-cased."""
    return F.transform(F.transform(lines, _stripped), ascii_lower)


def _line_hash(min_chars: int):
    """128 bits of a line's key; null for a key under min_chars code points."""

    def of(key: Column) -> Column:
        pair = F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))
        return F.when(F.char_length(key) >= min_chars, pair)

    return of


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, hashes): a line hash for each line of each row, in order."""
    text = whole_text(docs)
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("text_hash"),
        F.transform(line_keys(F.split(text, "\n")), _line_hash(min_chars)).alias("hashes"),
    )


@contextmanager
def _sorted_runs(spark: SparkSession):
    """For actions on runs: a bucket of one file counts as sorted.

    Spark 4.1 takes a union of bucketed tables as dealt by bucket and then groups it wrongly (found
    by test), which the second setting prevents; so no run is read outside of this.
    """
    own = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.unionOutputPartitioning": "false"}
    before = {name: spark.conf.get(name) for name in own}
    try:
        for name, value in own.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class LineRuns:
    """The line counts of all batches so far. buckets: of each run; Spark's shuffle partitions unless given."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _saved(self, counts: DataFrame) -> DataFrame:
        """The run of counts(h1, h2, n)."""
        with _sorted_runs(self.spark):
            return bucketed(counts, ["h1", "h2"], self.buckets)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The counts of all runs, added up in tasks before they are shuffled."""
        return reduce(DataFrame.union, runs).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def _put(self, run: DataFrame, level: int = 0) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_in:
            full, self.levels[level] = self.levels[level], []
            self._put(self._saved(self._merged(full)), level + 1)
            for old in full:
                discard(old)

    def _run_of(self, lines: DataFrame) -> DataFrame:
        """The run of a batch of hashed_lines(): each row counts once for each of its lines."""
        each = lines.select(F.explode(F.array_distinct("hashes")).alias("h")).where("h is not null")
        return self._saved(each.groupBy("h.h1", "h.h2").agg(F.count(F.lit(1)).alias("n")))

    def _before(self, run: DataFrame) -> DataFrame:
        """(h1, h2, seen) of a batch's run: in how many documents of earlier runs each line was."""
        met = run.select("h1", "h2", F.lit(0).cast("bigint").alias("seen"))
        for other in self.runs():
            met = met.join(other.hint("merge"), ["h1", "h2"], "left").select("h1", "h2", (F.col("seen") + F.coalesce("n", F.lit(0))).alias("seen"))
        return met

    def frequent(self, min_docs: int, of: DataFrame | None = None) -> DataFrame:
        """(h1, h2) of the lines in at least min_docs documents of all batches; of: of a run's only."""
        counts = self._merged(self.runs()) if of is None else self._before(of).withColumnRenamed("seen", "n")
        with _sorted_runs(self.spark):
            return written(counts.where(F.col("n") >= min_docs).select("h1", "h2"))

    def take(self, lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """A batch of hashed_lines(), which is added to the runs: (doc_id, text_hash, at, h1, h2),
        the positions of its lines without those that min_docs documents had before it."""
        each = lines.select("doc_id", "text_hash", F.posexplode("hashes").alias("at", "h")).where("h is not null")
        each = each.select("doc_id", "text_hash", "at", "h.h1", "h.h2")
        run = self._run_of(lines)
        if self.levels:
            each = written(without_keys(each, self.frequent(min_docs, run)))
        self._put(run)
        return each

    def ingest(self, docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
        """A new batch without the lines that min_docs documents had before it; adds its lines."""
        lines = written(hashed_lines(docs, min_chars))
        return without_lines(docs, lines, self.take(lines, min_docs))


def without_keys(each: DataFrame, frequent: DataFrame) -> DataFrame:
    """each without the rows whose h1, h2 are frequent, a written table: both sides are then plain
    shuffles, whose hot keys Spark splits."""
    return each.join(frequent.hint("merge"), ["h1", "h2"], "left_anti").select("doc_id", "text_hash", "at", "h1", "h2")


def without_lines(docs: DataFrame, lines: DataFrame, rare: DataFrame) -> DataFrame:
    """docs with text cut to the lines that are rare or have no hash, and n_lines, n_dropped.

    Only positions are shuffled by line; each text moves once, to meet its dropped positions. The
    other columns of docs travel in a struct, where no name can meet one of these.
    """
    keep = rare.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("rare_at"))
    hashed = F.expr("filter(sequence(0, size(hashes) - 1), i -> hashes[i] is not null)")
    hit = (
        lines.dropDuplicates(["doc_id", "text_hash"])
        .select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), hashed.alias("hashed_at"))
        .join(keep, F.col("l_id").eqNullSafe(F.col("doc_id")) & (F.col("l_hash") == F.col("text_hash")), "left")
        .select("l_id", "l_hash", F.array_except("hashed_at", F.coalesce("rare_at", F.array().cast("array<int>"))).alias("dropped_at"))
        .where("size(dropped_at) > 0")
    )
    others = [c for c in docs.columns if c.lower() != "text"]
    text = whole_text(docs)
    own = docs.select(F.struct(*[docs[c] for c in others]).alias("others"), docs["doc_id"].alias("own_id"), F.xxhash64(text).alias("own_hash"), text.alias("whole"))
    both = own.join(hit, F.col("own_id").eqNullSafe(F.col("l_id")) & (F.col("own_hash") == F.col("l_hash")), "left")
    both = both.withColumn("parts", F.split("whole", "\n"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("dropped_at"))
    cut = F.array_join(F.transform(rest, lambda i: F.get("parts", i)), "\n")
    kept = F.when(F.col("dropped_at").isNull(), F.col("whole")).otherwise(cut)
    return both.select(
        *[kept.alias(c) if c.lower() == "text" else F.col("others")[c].alias(c) for c in docs.columns],
        F.size("parts").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("dropped_at"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def drop_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """docs(doc_id, text, ...) with its frequent lines removed, plus n_lines and n_dropped.

    Texts are split at newlines; lines are alike if they agree after trimming ASCII white space
    and lower-casing A-Z. A line found in at least min_docs rows goes from all of them; keys
    under min_chars code points always stay. Null and empty texts are one empty line and come
    back empty. Repeated rows count as documents and all come back. Columns named n_lines or
    n_dropped are replaced, all others come back as they are. An empty table gives an empty result.

    Rows are dealt into batches, each taken by the runs; the last pass drops from each batch the
    lines that only later ones made frequent.
    """
    docs = docs.drop("n_lines", "n_dropped")
    lines = hashed_lines(docs, min_chars)
    lines = written(lines.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(batches)).cast("int")), "batch")
    runs = LineRuns(docs.sparkSession)
    left = [runs.take(lines.where(F.col("batch") == batch), min_docs) for batch in range(batches)]
    rare = without_keys(reduce(DataFrame.union, left), runs.frequent(min_docs))
    return without_lines(docs, lines.drop("batch"), rare)


def with_sizes(docs: DataFrame, before: DataFrame) -> DataFrame:
    """docs with n_chars, where before has it, counted anew from the text; its columns as before."""
    if "n_chars" in before.columns:
        kind = before.schema["n_chars"].dataType
        docs = docs.withColumn("n_chars", F.char_length("text").cast(kind))
    return docs.select(*before.columns)
