"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import pickle
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Keys of at most this many rows are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


#: Folders of the tables written here, which are removed when the program ends, and the sessions that made checkpoints.
_folders: dict[str, SparkSession] = {}
_checkpointed: dict[str, SparkSession] = {}
#: Database of the bucketed tables.
RUNS = "calendrix_runs"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir (or setCheckpointDir) names, which all executors share.

    Where none is set, a temporary folder serves a local session; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="calendrix-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage at a copy that survives lost executors."""
    shared_dir(df.sparkSession)
    # Spark gives each program a folder of its own in that folder.
    _checkpointed[df.sparkSession.sparkContext.getCheckpointDir()] = df.sparkSession
    return df.checkpoint()


def _new_folder(spark: SparkSession) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _folders[path] = spark
    return path


def written(df: DataFrame, by: str | None = None) -> DataFrame:
    """Like durable(), as compressed columns: for wide or text-heavy tables. by: a column of few
    values, each of which is to be read on its own."""
    path = _new_folder(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """Like written(), with one sorted file for each bucket of the keys, so that tables of the same
    buckets are joined and grouped by them without a shuffle."""
    path = _new_folder(df.sparkSession)
    name = f"{RUNS}.t_{path.rsplit('-', 1)[-1]}"
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {RUNS}")
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def _remove(path: str) -> None:
    spark = _folders.pop(path)
    if spark.catalog.databaseExists(RUNS):
        spark.sql(f"DROP TABLE IF EXISTS {RUNS}.t_{path.rsplit('-', 1)[-1]}")
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(df: DataFrame) -> None:
    """Removes the table behind a result of written() or bucketed() that is no longer read."""
    for file in df.inputFiles()[:1]:
        for path in [p for p in _folders if p.rsplit("/", 1)[-1] == file.rsplit("/", 2)[-2]]:
            _remove(path)


@atexit.register
def discard_all() -> None:
    """Removes all tables and checkpoints made here; results that still read them must have been saved."""
    for path in list(_folders):
        try:
            _remove(path)
        except Exception:  # the JVM has gone first; the folder is left to the cluster
            _folders.pop(path, None)
    for path, spark in [_checkpointed.popitem() for _ in range(len(_checkpointed))]:
        try:
            _delete(spark, path)
        except Exception:  # as above
            continue


class Sent:
    """A value that was sent once to each executor, where calling this gives it."""

    def __init__(self, spark: SparkSession, value):
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __call__(self):
        return pickle.loads(self.packed.value)

    def unpersist(self) -> None:
        """Frees the executors' copies; a task that still needs the value fetches it again."""
        self.packed.unpersist()


def sent(spark: SparkSession, value) -> Sent:
    return Sent(spark, value)


def whole_text(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def sliced(batches, rows: int = 1024):
    """The batches in pieces, so that a task holds the texts of a piece at a time as Python's."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch of whole rows, whatever the column's case and type; null as empty."""
    column = batch.column([c.lower() for c in batch.schema.names].index(text))
    return [t or "" for t in column.cast(pa.string()).to_pylist()]


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only; lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(
        F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())
    )


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    names = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in names:
        n += 1
        name = f"{stem}_{n}"
    return name
