"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of ORDERS characters of the lower-cased text, with single spaces, that a
document has at least once. Each is scaled by the log ratio of its smoothed document frequencies in toxic and other
training documents (Wang and Manning, 2012), and a logistic regression on the scaled features is
fitted and calibrated on held-back training rows.

Fitting is bounded: at most PER_CLASS labelled documents of each class (those with the least hash
of their doc_id) and FEATURES n-grams. Scoring covers every document and its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import durable, sliced, texts_of, whole_text

ORDERS, PER_CLASS, FEATURES, MIN_DOCS, THRESHOLD, FOLDS, HELD_OUT = (4, 5, 6), 2000, 4096, 3, 0.7, 3, 1
#: Characters of text looked at together.
CHUNK = 1 << 19
BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learnt from: crc32 of its id as text, modulo FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _chunks(texts):
    """(code points, document of each) of about CHUNK characters; texts are kept apart by zeros,
    and a long text is continued with an overlap of the longest n-gram less one."""
    parts, owners, size = [], [], 0
    gap, overlap = "\0" * max(ORDERS), max(ORDERS) - 1

    def made():
        return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32), np.repeat(*map(list, zip(*owners)))

    for i, text in enumerate(texts):
        data = f" {' '.join(text.lower().replace(chr(0), ' ').split())} "
        for at in range(0, len(data), CHUNK):
            part = data[at : at + CHUNK + overlap] + gap
            parts.append(part)
            owners.append((i, len(part)))
            size += len(part)
            if size >= CHUNK:
                yield made()
                parts, owners, size = [], [], 0
    if parts:
        yield made()


def _codes(data: np.ndarray):
    """(n, 64-bit hash of the n-gram that starts at each character) for each n of ORDERS."""
    wide = data.astype(np.uint64)
    wide = (wide + np.uint64(1)) * BASE
    wide ^= wide >> np.uint64(29)
    code = wide
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * BASE + wide[n - 1 :]
        if n in ORDERS:
            yield n, code ^ (code >> np.uint64(31)) ^ np.uint64(n)


def _inside(data: np.ndarray, n: int) -> np.ndarray:
    zeros = np.r_[0, np.cumsum(data == 0)]
    return zeros[n:] == zeros[:-n]


@dataclass
class Model:
    """codes: sorted n-grams; weights: of each; the score is a logistic function of their sum."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    constant: float | None = None

    def __post_init__(self):
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)

    def features(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of each feature that each text has."""
        found = [np.zeros(0, np.int64)]
        for data, owner in _chunks(texts):
            for _, codes in _codes(data):
                at = np.flatnonzero(self.maybe[self._slot(codes)])
                place = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
                hit = self.codes[place] == codes[at] if len(self.codes) else np.zeros(len(at), bool)
                found.append(np.unique(owner[at[hit]].astype(np.int64) << 32 | place[hit]))
        pairs = np.unique(np.concatenate(found))
        return pairs >> 32, pairs & 0xFFFFFFFF

    def scores(self, texts) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        doc, feature = self.features(texts)
        total = np.bincount(doc, self.weights[feature], len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(text, y) of the training documents: labelled 0 or 1, not held out, at most per_class of
    each class. Of rows that repeat a doc_id, one is taken: that with the least text hash."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id").where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("y = 1").orderBy(*order).limit(per_class).union(known.where("y = 0").orderBy(*order).limit(per_class))
    picked = durable(picked)  # at most 2 * per_class rows
    text = whole_text(docs)
    met = docs.select("doc_id", F.struct(F.xxhash64(text).alias("digest"), text.alias("text")).alias("e")).join(F.broadcast(picked), "doc_id")
    return met.groupBy("doc_id", "y").agg(F.min("e").alias("e")).select("e.text", "y")


def _counts(batches):
    """(code, pos, neg): documents of each class that have each n-gram, within a batch."""
    for pdf in batches:
        y, found = pdf.y.to_numpy(), []
        for data, owner in _chunks(pdf.text):
            for n, codes in _codes(data):
                inside = _inside(data, n)
                own = np.stack([owner[: len(codes)][inside].astype(np.uint64), codes[inside]], axis=1)
                order = np.lexsort((own[:, 1], own[:, 0]))
                own = own[order]
                found.append(own[np.r_[True, (own[1:] != own[:-1]).any(axis=1)]] if len(own) else own)
        if not found:
            continue
        rows = np.concatenate(found)
        codes, index = np.unique(rows[:, 1], return_inverse=True)
        toxic = y[rows[:, 0].astype(np.int64)] == 1
        pos = np.bincount(index[toxic], minlength=len(codes))
        yield pd.DataFrame({"code": codes.view(np.int64), "pos": pos, "neg": np.bincount(index, minlength=len(codes)) - pos})


def _regression(doc, feature, values, y, n_features, rounds=1500, l2=0.05):
    """Logistic regression by accelerated gradient descent; returns (weights, bias)."""
    n = len(y)
    w, v, b, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    norm = np.bincount(doc, values[feature] ** 2, n).max(initial=0.0) + 1
    step = 4.0 / (norm + 4 * l2 / n)
    for k in range(rounds):
        rate = k / (k + 3)
        wy, by = w + rate * v, b + rate * vb
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, (wy * values)[feature], n) + by, -50, 50)))
        gap = (p - y) / n
        grad = np.bincount(feature, gap[doc], n_features) * values + l2 / n * wy
        new_w, new_b = wy - step * grad, by - step * gap.sum()
        v, vb, w, b = new_w - w, new_b - b, new_w, new_b
    return w, b


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, features: int = FEATURES) -> Model:
    """The classifier of docs(doc_id, text) and labels(doc_id, toxic).

    Held-out, unlabelled and other rows than 0 and 1 are not learnt from; a doc_id labelled twice
    is toxic if any label says so. Where a class has no rows, all scores are 1 if all labels are
    toxic, else 0.
    """
    rows = durable(_sample(docs, labels, per_class))
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not pos or not neg:
        return Model(none, np.zeros(0), 0.0, constant=float(pos > 0))
    counts = rows.mapInPandas(_counts, "code bigint, pos bigint, neg bigint").groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = F.log((F.col("pos") + 1) / (pos + 2)) - F.log((F.col("neg") + 1) / (neg + 2))
    gain = F.abs(F.col("pos") / pos - F.col("neg") / neg) * F.abs(ratio)
    best = counts.where(F.col("pos") + F.col("neg") >= min(MIN_DOCS, pos)).select("code", ratio.alias("ratio"), gain.alias("gain"))
    best = best.orderBy(F.desc("gain"), "code").limit(features).toPandas()  # bounded by features
    codes = best.code.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes, ratios = codes[order], best.ratio.to_numpy(float)[order]
    model = Model(codes, np.zeros(len(codes)), 0.0)

    def listed(batches):
        for pdf in batches:
            doc, feature = model.features(pdf.text)
            cuts = np.searchsorted(doc, np.arange(1, len(pdf)))
            yield pdf[["y", "back", "digest"]].assign(features=[x.astype(np.int32) for x in np.split(feature, cuts)])

    # At most 2 * per_class rows of at most `features` numbers. A fifth calibrates.
    marked = rows.select("text", "y", (F.crc32(F.col("text").cast("binary")) % 5 == 4).alias("back"), F.xxhash64("text").alias("digest"))
    found = marked.mapInPandas(listed, "y int, back boolean, digest bigint, features array<int>").toPandas().sort_values("digest", kind="stable")
    y, back = found.y.to_numpy(float), found.back.to_numpy(bool)
    lists = [np.asarray(x, np.int64) for x in found.features]
    doc, feature = np.repeat(np.arange(len(y)), [len(x) for x in lists]), np.concatenate(lists)
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    fit = ~back[doc]
    row = np.cumsum(~back) - 1
    weights, bias = _regression(row[doc[fit]], feature[fit], ratios, y[~back], len(codes))
    margin = np.bincount(doc, (weights * ratios)[feature], len(y)) + bias
    use = back if back.any() else ~back
    slope, shift = _platt(margin[use], y[use])
    return Model(codes, weights * ratios * slope, bias * slope + shift)


def _platt(margin, y, rounds=50):
    """(slope, shift) of the logistic calibration, with smoothed targets, by Newton's method."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        h = np.array([[(w * margin * margin).sum(), (w * margin).sum()], [(w * margin).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    return max(a, 1e-3), b


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) as (doc_id, held_out, score, predicted); null texts count as empty."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": model.scores(pdf.text)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", whole_text(docs).alias("text")).mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all its columns, without the rows scored at the threshold or above."""

    def run(batches):
        for batch in sliced(batches):
            yield batch.filter(pa.array(model.scores(texts_of(batch)) < threshold))

    return docs.mapInArrow(run, docs.schema)
