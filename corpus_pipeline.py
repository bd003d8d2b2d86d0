"""The training-corpus pipeline: toxicity, line dedup, SimHash, decontamination, mixing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), where docs is all that
the stage before kept, and returns a DataFrame with the columns of documents (the last one adds
copy_no and mix_key). run() applies them to documents. Stages handle null and empty texts, repeated
rows, empty tables and extra columns as their operators state; columns that an operator adds for
itself (n_lines, n_dropped) do not leave its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from calendrix.llm import decontaminate, line_dedup, mixing, near_copies, toxicity
from calendrix.llm.catalog import MIX_WEIGHTS, table
from calendrix.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels table."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; n_chars follows the text.

    A line in 10 or more documents goes from all of them, as op4 has it. A text with 10 or more
    exact copies so loses all its lines in every copy, and the SimHash stage joins the emptied ones.
    """
    return line_dedup.with_sizes(line_dedup.drop_frequent_lines(docs).drop("n_lines", "n_dropped"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at a likeness of 0.8 or more in five-word shingles."""
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to the sources' target weights, in random order."""
    return mixing.mix(docs, MIX_WEIGHTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
]

#: A trained classifier's scores are no SQL; tests/llm holds run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs)
    return docs
