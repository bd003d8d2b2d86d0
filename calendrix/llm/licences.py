"""Finds licence paragraphs with a trained classifier, in DataFrame functions only.

A multinomial logistic regression on word bigrams and trigrams tells the licence families and an
unknown class apart. It is trained on windows of the families' whole texts (licence_texts) and
notices, and on all of the corpus' own paragraphs for the unknown class: those with the same n-grams are one row with
its weight. A prediction counts if the probability of any family is above a level calibrated on the third of the unknown
paragraphs that was not trained on, and it is confirmed if the paragraph and one of the family's paragraphs agree: the
shorter one has SIMILAR or more of its five-word shingles in the other. Paragraphs that families
share are found as one of them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calendrix.llm.common import durable, whole_text

WORDS, SIMILAR, UNKNOWN, VOCABULARY, QUANTILE = 5, 0.8, "unknown", 12_000, 0.999
#: Words that a paragraph of a licence text has at least; shorter ones are headings.
SHORTEST = 8
FITTING_TASKS, ROUNDS = 3, 20
#: Rows of a fitting task, where that makes more tasks.
FITTING_ROWS = 100_000
#: Likeliest families whose paragraphs are compared.
TRIED = 3

# Public licence texts, a file for each family, paragraphs divided by blank lines, and
# the notices by which works name their licence.
FOLDER = Path(__file__).with_name("licence_texts")
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "ISC": ["Licensed under the ISC License.", "This project is released under the terms of the ISC License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "Use of this source code is governed by the Simplified BSD License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": ["Licensed under the Mozilla Public License, Version 2.0."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "Unlicense": ["Released into the public domain under the Unlicense."],
    "Zlib": ["Licensed under the zlib License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Artistic": ["Distributed under the terms of the Artistic License."],
}


def licence_paragraphs(folder: Path = FOLDER, notices: dict[str, list[str]] = NOTICES) -> dict[str, list[str]]:
    """The paragraphs of each family, on one line each, without headings; its notices come first."""
    out = {family: list(own) for family, own in notices.items()}
    for file in sorted(folder.glob("*.txt")):
        blocks = (" ".join(block.split()) for block in re.split(r"\n\s*\n", file.read_text(encoding="utf-8")))
        out.setdefault(file.stem, []).extend(b for b in blocks if len(re.findall(r"\w+", b)) >= SHORTEST)
    return {family: list(dict.fromkeys(own)) for family, own in out.items()}


TEXTS = licence_paragraphs()


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def grams(words: Column, of: list[str] | None = None) -> Column:
    """Bigrams and trigrams of a word array; of: only those that have no other words than these."""
    if of is not None:
        return F.get(F.transform(F.array(F.transform(words, lambda w: F.when(w.isin(of), w))), _joined), F.lit(0))
    n = F.size(words)
    # get() costs the same for every i, where slice() reads the whole array each time.
    run = lambda k: F.transform(
        F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)])
    )
    return F.concat(run(2), run(3))


def _joined(words: Column) -> Column:
    """Bigrams and trigrams of a word array that have no null. Most words of a corpus are null here, so few strings are made."""

    def at(word: Column, i: Column) -> Column:
        pair = F.concat(word, F.lit(" "), F.get(words, i + 1))  # null if a word is
        return F.when(word.isNotNull() & F.get(words, i + 1).isNotNull(), F.array(pair, F.concat(pair, F.lit(" "), F.get(words, i + 2))))

    return F.array_compact(F.flatten(F.array_compact(F.transform(words, at))))


def shingles(words: Column) -> Column:
    """Hashes of the five-word shingles; of all words if there are fewer."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))
    # get() past the end gives null, which the hash passes over.
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)])))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words) of the lines with words of docs(doc_id, text).

    The words leave the generator ready made: a later filter on what is derived from them can then
    not be moved below it, where they would be split anew for each n-gram.
    """
    lines = F.transform(F.split(whole_text(docs), "\n"), words_of)
    return docs.select("doc_id", F.posexplode(lines).alias("paragraph", "words")).where(F.size("words") > 0)


def templates(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    rows = [(family, text) for family, own in texts.items() for text in own]
    return spark.createDataFrame(rows, "family string, text string").withColumn("words", words_of(F.col("text")))


def _windows(rows: DataFrame) -> DataFrame:
    """(family, words): each paragraph whole, and its windows of 12 and 30 words at every tenth word."""
    n = F.size("words")
    starts = lambda k: F.when(n > k, F.sequence(F.lit(1), n - (k - 1), F.lit(10))).otherwise(F.array().cast("array<int>"))
    cut = lambda k: F.transform(starts(k), lambda i: F.slice("words", i, k))
    return rows.select("family", F.explode(F.concat(F.array("words"), cut(12), cut(30))).alias("words"))


@dataclass
class LicenceModel:
    families: list[str]
    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    level: float

    @property
    def words(self) -> list[str]:
        """The words of the vocabulary's n-grams."""
        return sorted({word for gram in self.vocabulary.vocabulary for word in gram.split(" ")})

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """rows(words) with family_p (the probability of each family), best (the number of the
        likeliest) and licence_p (the probability of any)."""
        counted = self.vocabulary.transform(rows.withColumn("_grams", grams(F.col("words"), self.words)))
        scored = self.regression.transform(counted).withColumn("_p", vector_to_array("probability"))
        known = F.slice("_p", 1, len(self.families))
        return (
            scored.withColumn("licence_p", 1 - F.element_at("_p", -1))
            .withColumn("family_p", known)
            .withColumn("best", F.array_position("family_p", F.array_max("family_p")).cast("int") - 1)
            .drop("_grams", "_features", "rawPrediction", "probability", "prediction", "_p")
        )


def _vocabulary(rows: DataFrame, each: int = VOCABULARY) -> list[str]:
    """The n-grams in most windows of rows(_grams, label), up to `each` of every family."""
    counts = rows.select("label", F.explode(F.array_distinct("_grams")).alias("gram")).groupBy("label", "gram").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return [r.gram for r in best.select("gram").distinct().orderBy("gram").collect()]  # each * families at most


def _unknown(docs: DataFrame, texts: dict[str, list[str]], vocabulary: CountVectorizerModel) -> DataFrame:
    """(_features, back, n): how often each set of n-grams is that of a line of docs in which neither licen nor copyright
    occurs; back: of the third that is not trained on. Lines with half of their shingles or more in the texts are left out:
    licence texts of the corpus itself must not pass for unknown.

    Lines are read once, and become rows of the n-grams that have words of the texts only. A line with half of its
    shingles in the texts has many of these; only where there are enough are the words kept for the comparison. Of k different
    shingles in the texts, k + 3 bigrams and k + 2 trigrams are there, and a line has as many shingles as different words
    less 4, or more.
    """
    own = templates(docs.sparkSession, texts)
    of = sorted(r.w for r in own.select(F.explode("words").alias("w")).distinct().collect())  # of the texts' size
    shortest = min((r.n for r in own.select(F.size("words").alias("n")).collect()), default=0)
    plain = F.filter(F.split(whole_text(docs), "\n"), lambda t: ~F.lower(t).contains("licen") & ~F.lower(t).contains("copyright"))
    # Words leave the generator ready made, as in paragraphs().
    lines = docs.select(F.explode(F.transform(plain, words_of)).alias("words")).where(F.size("words") > 0)
    back = F.pmod(F.xxhash64("words", F.lit(1)), F.lit(3)) == 0
    lines = lines.select("words", back.alias("back"), grams(F.col("words"), of).alias("_grams"))
    least = F.greatest(F.size(F.array_distinct("words")) + 1, F.lit(2 * WORDS - 3))
    near = F.when(F.size("words") >= WORDS, F.size("_grams") >= least).otherwise(F.lit(0 < shortest < WORDS))
    keys = [F.array_sort(F.array_distinct("_grams")).alias("_grams"), "back", F.when(near, F.col("words")).alias("words")]
    counts = durable(lines.select(*keys).groupBy("_grams", "back", "words").agg(F.count(F.lit(1)).cast("double").alias("n")))
    known = own.select(F.explode(shingles(F.col("words"))).alias("s")).distinct().withColumn("met", F.lit(1))
    compared = counts.where("words IS NOT NULL").select("words").distinct().select("words", F.explode(shingles(F.col("words"))).alias("s"))
    compared = compared.join(F.broadcast(known), "s", "left").groupBy("words").agg(F.count("met").alias("met"), F.count(F.lit(1)).alias("all"))
    like = compared.where("met * 2 >= all").select("words")
    # Most rows have no words here, and would all meet in one task of the join.
    kept = counts.where("words IS NULL").unionByName(counts.where("words IS NOT NULL").join(like, "words", "left_anti"))
    counted = vocabulary.transform(kept)
    same = counted.groupBy(F.col("_features").cast("string").alias("key"), "back").agg(F.first("_features").alias("_features"), F.sum("n").alias("n"))
    return same.select("_features", "back", "n")


def train(docs: DataFrame, texts: dict[str, list[str]] = TEXTS) -> LicenceModel:
    """A model of the families of texts; the unknown class is of all lines of docs but licence-like ones (_unknown). As
    there are many more of these than of the texts' windows, all of them together weigh as much as all windows at most."""
    spark = docs.sparkSession
    families = sorted(texts)
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    known = _windows(templates(spark, texts)).select(grams(F.col("words")).alias("_grams"), number.alias("label"))
    known = durable(known.coalesce(FITTING_TASKS))
    vocabulary = CountVectorizerModel.from_vocabulary(_vocabulary(known), "_grams", "_features")
    vocabulary = vocabulary.setBinary(True)
    plain = durable(_unknown(docs, texts, vocabulary))
    size = plain.where("not back").agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    share = min(1.0, known.count() / size.n) if size.n else 1.0
    seed = spark.createDataFrame([(["of", "the", "and"],), (["no"],)], "words array<string>")  # for an empty corpus
    seed = vocabulary.transform(seed.select(grams(F.col("words")).alias("_grams"))).select("_features", F.lit(1.0).alias("weight"))
    other = plain.where("not back").select("_features", (F.col("n") * share).alias("weight")).union(seed)
    rows = vocabulary.transform(known).select("_features", "label", F.lit(1.0).alias("weight"))
    rows = rows.union(other.select("_features", F.lit(float(len(families))), "weight"))
    # Few partitions, as each sends a gradient of families * vocabulary in each round.
    rows = durable(rows.repartition(max(FITTING_TASKS, -(-size.rows // FITTING_ROWS))))
    regression = LogisticRegression(featuresCol="_features", weightCol="weight", family="multinomial", regParam=1e-4, maxIter=ROUNDS, tol=1e-4)
    model = LicenceModel(families, vocabulary, regression.fit(rows), 0.5)
    scored = model.regression.transform(plain.where("back")).select("n", F.round(1 - F.element_at(vector_to_array("probability"), -1), 5).alias("p"))
    by_level = scored.groupBy("p").agg(F.sum("n").cast("bigint").alias("n"))  # 100,001 rows at most
    seen = by_level.agg(F.percentile("p", QUANTILE, F.col("n"))).first()[0]
    model.level = max(0.5, min(0.9, 1.05 * seen)) if seen is not None else 0.5
    return model


def scan(docs: DataFrame, model: LicenceModel, texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed), a row for each paragraph
    of docs(doc_id, text) that is predicted to be of a licence; probability: that it is of any family,
    family: of the TRIED likeliest the first that is confirmed, else the likeliest.

    Paragraphs are lines, counted from 0. Null and empty texts have none; lines without words are
    passed over; repeated rows give their rows each; other columns are not read.
    """
    spark = docs.sparkSession
    hits = model.probabilities(paragraphs(docs)).where(F.col("licence_p") > model.level)
    named = F.zip_with("family_p", F.array(*map(F.lit, model.families)), lambda p, f: F.struct(p.alias("p"), f.alias("family")))
    likeliest = F.slice(F.sort_array(named, asc=False), 1, TRIED)
    hits = hits.select("doc_id", "paragraph", "licence_p", likeliest.alias("likeliest"), shingles(F.col("words")).alias("own"))
    by_family = templates(spark, texts).groupBy("family").agg(F.collect_list(shingles(F.col("words"))).alias("texts"))
    known = by_family.agg(F.collect_list(F.struct("family", "texts")).alias("known"))  # one row, of the texts' size
    met = hits.crossJoin(F.broadcast(known))
    overlap = lambda t: F.size(F.array_intersect("own", t)) / F.least(F.size("own"), F.size(t))
    best = lambda f: F.array_max(F.transform(F.get(F.filter("known", lambda k: k["family"] == f), F.lit(0))["texts"], overlap))
    tried = F.transform("likeliest", lambda c: F.struct(c["family"].alias("family"), best(c["family"]).alias("similarity")))
    met = met.withColumn("tried", tried)
    # The likeliest family that is confirmed, else the likeliest.
    taken = F.coalesce(F.get(F.filter("tried", lambda t: t["similarity"] >= SIMILAR), F.lit(0)), F.get("tried", F.lit(0)))
    met = met.withColumn("taken", taken)
    return met.select(
        "doc_id", "paragraph", F.col("taken.family").alias("family"), F.col("licence_p").alias("probability"), F.col("taken.similarity").alias("similarity"), (F.col("taken.similarity") >= SIMILAR).alias("confirmed")
    )
