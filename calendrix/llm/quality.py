"""Text quality by positive-unlabelled learning: a linear classifier of minimal non-negative risk.

Trusted positives are the documents labelled good; all training documents, whatever their label, are the
unlabelled text. With the logistic loss l, the class prior pi and margins z the risk of a
classifier is (du Plessis et al., 2015, and Kiryo et al., 2017)

    pi E_P[l(z)] + max(0, E_U[l(-z)] - pi E_P[l(-z)]),

where the second term, the risk on the unseen negatives, can't be below 0 and is held there. As
l(z) - l(-z) = -z, the risk with that term weighted by any theta from 0 to 1 is convex, and the least
non-negative risk is the saddle point over theta: 1 where the term is positive, else the theta that
brings it to 0. Newton steps find weights and theta together.

The prior is estimated from the same two samples by best bin estimation (Garg et al., 2021): each half of
the rows is scored by a classifier of positives against unlabelled text that the other half has
fitted, and the least ratio of the shares of unlabelled and positive rows above a cut, with an
allowance for small samples, bounds the share of positives. Classifiers of least risk at that prior, fitted and
measured in the same way, then tighten the bound REFINEMENTS times. Labels of bad documents are never used.

Every pass covers all training rows: tasks add up the gradient and curvature of their rows, which
meet FAN at a time. Nothing is sampled.

Features of a text are square roots of the shares of neighbouring character classes (letter cases, digits, kinds of
punctuation) and measures of repetition and size, taken over whole texts in pieces of CHUNK characters.
Null texts count as empty, and empty ones get the score of their features, all 0. Rows that repeat a doc_id are scored one
by one. A doc_id labelled twice is trusted if all its labels are 1; null and other labels are none.
Without a positive every score is 0; without documents there are no rows.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from dataclasses import dataclass
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import sent, whole_text, written

THRESHOLD, FOLDS, HELD_OUT, RIDGE = 0.7, 4, 2, 1e-3
#: Characters looked at together, words of which distinct ones are counted, sums that one task adds up.
CHUNK, WINDOW, FAN = 1 << 19, 100, 8
STEPS, CLOSE, REFINEMENTS = 30, 1e-6, 2
#: Margins from MOST to -MOST are counted in so many bins.
BINS, MOST = 2000, 20
#: Best bin estimation: confidence and slack.
DELTA, GAMMA = 0.1, 0.01

#: Kinds of characters that have a class of their own; 0 is the outside of a text.
PUNCTUATION = (".", ",;:", "!", "?", "'\"-()[]’‘“”«»–—", "|", "#$%&*@+", "/\\<>=~^_`{}")
CLASSES = 16
SPACE, NEWLINE, LOWER, UPPER, DIGIT, MARKS, CONTROL, OTHER = 1, 2, 3, 4, 5, 6, 14, 15
MEASURES = 10
SIZE = CLASSES * CLASSES + MEASURES


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is never learnt from: crc32 of its id as text, modulo FOLDS."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


# -- features ---------------------------------------------------------------------------------------


@cache
def _classes() -> np.ndarray:
    """The class of each character."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for code in range(0x3000):
        char, kind = chr(code), unicodedata.category(chr(code))
        if char in "\n\r\x0b\x0c\x85\u2028\u2029":
            table[code] = NEWLINE
        elif char.isspace():
            table[code] = SPACE
        elif kind in ("Lu", "Lt"):
            table[code] = UPPER
        elif kind[0] in "LM":
            table[code] = LOWER
        elif kind[0] == "N":
            table[code] = DIGIT
        elif kind[0] == "C":
            table[code] = CONTROL
    table[0x3000:0xD800] = LOWER  # scripts without case
    table[0xD800:0xF900] = CONTROL  # surrogates and private use
    for n, chars in enumerate(PUNCTUATION):
        table[[ord(c) for c in chars]] = MARKS + n
    return table


def _words(text: str):
    """The words, CHUNK characters at a time; a longer word is taken in pieces."""
    rest = ""
    for at in range(0, len(text), CHUNK):
        piece = rest + text[at : at + CHUNK]
        words = piece.split()
        rest = words.pop() if words and not piece[-1].isspace() and len(words[-1]) < CHUNK else ""
        yield words
    if rest:
        yield [rest]


def _measures(text: str) -> list[float]:
    total = distinct = equal1 = equal2 = short = 0
    longest, before = 0, []
    for words in _words(text):
        total += len(words)
        for at in range(0, len(words), WINDOW):
            distinct += len(set(words[at : at + WINDOW]))
        near, first = before + words, max(len(before), 1)
        equal1 += sum(map(eq, near[first:], near[first - 1 :]))
        equal2 += sum(map(eq, near[2:], near))
        short += sum(len(w) <= 2 for w in words)
        longest = max(longest, max(map(len, words), default=0))
        before = near[-2:]
    lines, at, filled, seen = 0, 0, 0, set()
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end].strip()
        if line:
            filled += 1
            seen.add(zlib.crc32(line.encode("utf-8", "surrogatepass")) & 0xFFFFF)
        lines, at = lines + 1, end + 1
    some = max(total, 1)
    return [
        equal1 / some, equal2 / some, 1 - distinct / some if total else 0.0, short / some, min(longest, 1000) / 1000,
        min(len(text) / some, 40) / 40, np.log1p(len(text)) / 20, np.log1p(total) / 20, 1 - len(seen) / filled if filled else 0.0, min(lines / some, 1),
    ]


def features(texts: list[str]) -> np.ndarray:
    """A row of SIZE numbers from 0 to 1 for each text."""
    out = np.zeros((len(texts), SIZE), np.float32)
    table = _classes()
    for row, text in zip(out, texts):
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        last = 0
        for at in range(0, len(text), CHUNK):
            codes = table[np.frombuffer(text[at : at + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int16)
            pairs += np.bincount(np.r_[last, codes[:-1]] * CLASSES + codes, minlength=CLASSES * CLASSES)
            last = int(codes[-1])
        if len(text):
            row[: CLASSES * CLASSES] = np.sqrt(pairs / len(text))
            row[CLASSES * CLASSES :] = _measures(text)
    return out


def featured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, x, held_out, positive, half) of each row of docs(doc_id, text); x are its features as bytes.

    half deals rows into two halves by their text, so copies are in one.
    """

    def run(batches):
        for batch in batches:
            rows = features(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["half"], pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "half", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole_text(docs)
    rows = docs.select("doc_id", text.alias("text"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, half int, x binary").withColumn("held_out", held_out())
    trusted = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("positive"))
    trusted = trusted.where(F.col("positive") & ~held_out())
    met = rows.join(trusted, "doc_id", "left")
    return written(met.select("doc_id", "x", "held_out", F.coalesce("positive", F.lit(False)).alias("positive"), "half"))


# -- sums over all rows -----------------------------------------------------------------------------


@dataclass
class Sums:
    """Over some rows at some weights: their count, losses l(z) and l(-z), sums of x and sigma(z) x, and of
    sigma(z)(1 - sigma(z)) x x'. The last entry of x is 1."""

    n: float
    loss: float
    loss_other: float
    x: np.ndarray
    pull: np.ndarray
    curve: np.ndarray

    @staticmethod
    def unpacked(flat: np.ndarray) -> Sums:
        d = SIZE + 1
        return Sums(*flat[:3], flat[3 : 3 + d], flat[3 + d : 3 + 2 * d], flat[3 + 2 * d :].reshape(d, d))


def _matrix(column) -> np.ndarray:
    rows = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, SIZE)
    return np.hstack([rows.astype(float), np.ones((len(rows), 1))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _flat(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights
    s = _sigmoid(z)
    loss = np.logaddexp(0, -z).sum()
    return np.r_[len(x), loss, loss + z.sum(), x.sum(axis=0), s @ x, (x.T @ (x * (s * (1 - s))[:, None])).ravel()]


def _added(batches):
    """One row for each group of a task's rows."""
    sums = {}
    for batch in batches:
        for *group, total in zip(*(batch[c].to_pylist() for c in ("fit", "positive", "node", "total"))):
            own = np.frombuffer(total)
            sums[tuple(group)] = sums[tuple(group)] + own if tuple(group) in sums else own
    for group, total in sums.items():
        yield pa.RecordBatch.from_pylist([dict(zip(("fit", "positive", "node"), group)) | {"total": total.tobytes()}])


_TOTAL = "fit bigint, positive boolean, node bigint, total binary"


def sums(rows: DataFrame, tasks: int, weights: list[np.ndarray]) -> list[tuple[Sums, Sums]]:
    """Of the positive rows and of all rows, of rows(x, positive, half) in that many tasks. Of two
    weights the first is measured on half 0 and the second on half 1; a single one on all."""
    model = sent(rows.sparkSession, weights)

    def run(batches):
        own, found = model(), {}
        for batch in batches:
            x, positive, half = (_matrix(batch["x"]), *(batch[c].to_numpy(zero_copy_only=False) for c in ("positive", "half")))
            for fit, w in enumerate(own):
                on = half == fit if len(own) > 1 else np.ones(len(x), bool)
                for group, part in ((False, x[on]), (True, x[on & positive])):
                    if len(part):
                        found[fit, group] = found.get((fit, group), 0) + _flat(part, w)
        for (fit, group), total in found.items():
            yield pa.RecordBatch.from_pylist([{"fit": fit, "positive": group, "node": TaskContext.get().partitionId(), "total": total.tobytes()}])

    level = rows.select("x", "positive", "half").mapInArrow(run, _TOTAL)
    while tasks > FAN:
        tasks = -(-tasks // FAN)
        level = level.withColumn("node", F.floor(F.col("node") / FAN)).repartition(tasks, "node").mapInArrow(_added, _TOTAL)
    flat = {}
    for row in level.collect():  # at most FAN rows of each fit and group
        key = (row.fit, row.positive)
        flat[key] = flat.get(key, 0) + np.frombuffer(row.total)
    model.unpersist()
    return [tuple(Sums.unpacked(flat[fit, group]) for group in (True, False)) for fit in range(len(weights))]


# -- the fit ----------------------------------------------------------------------------------------


def _penalty(everything: Sums, ridge: float) -> np.ndarray:
    """The ridge on weights of features at unit variance; everything are sums at weights of 0."""
    mean = everything.x / everything.n
    spread = np.maximum(4 * np.diag(everything.curve) / everything.n - mean**2, 0)
    penalty = ridge * np.where(spread > 1e-12, spread, 1.0)
    penalty[-1] = 0.0
    return penalty


def _solved(curve: np.ndarray, *sides: np.ndarray) -> list[np.ndarray]:
    scale = 1 / np.sqrt(np.maximum(np.diag(curve), 1e-12))
    found = np.linalg.solve(curve * scale[:, None] * scale + 1e-10 * np.eye(len(curve)), np.stack(sides, 1) * scale[:, None])
    return list((found * scale[:, None]).T)


def _descend(measure, steps: list, rounds: int = STEPS) -> list[np.ndarray]:
    """Newton's method on several fits side by side: measure(list of weights) gives the sums of each,
    a step of (sums, weights, theta) the value there, the next move, its promise and theta. A move that does
    not lower its value is halved."""
    weights = [np.zeros(SIZE + 1) for _ in steps]
    now = [step(at, w, 1.0) for step, at, w in zip(steps, measure(weights), weights)]
    for _ in range(rounds):
        going = [promise >= CLOSE for _, _, promise, _ in now]
        if not any(going):
            break
        tried = [w + n[1] if go else w for w, n, go in zip(weights, now, going)]
        for i, at in enumerate(measure(tried)):
            if not going[i]:
                continue
            value, move, promise, theta = now[i]
            found = steps[i](at, tried[i], theta)
            if found[0] > value + 1e-9 * abs(value):
                now[i] = (value, move / 2, promise / 4, theta)
            else:
                weights[i], now[i] = tried[i], found
    return weights


def separating(penalty: np.ndarray):
    """The step of a logistic regression of positives against unlabelled rows."""

    def step(found, w, theta):
        p, u = found
        value = p.loss / p.n + u.loss_other / u.n + (penalty * w * w).sum() / 2
        gradient = (p.pull - p.x) / p.n + u.pull / u.n + penalty * w
        (move,) = _solved(p.curve / p.n + u.curve / u.n + np.diag(penalty), -gradient)
        return value, move, -gradient @ move, theta

    return step


def best_bin(positive: np.ndarray, everything: np.ndarray) -> float:
    """The share of positives, of the counts of positive and of all rows by bins of a falling score."""
    n_p, n_u = positive.sum(), everything.sum()
    above_p, above_u = np.cumsum(positive) / n_p, np.cumsum(everything) / n_u
    some = above_p > 0
    slack = (1 + GAMMA) * (np.sqrt(np.log(4 / DELTA) / (2 * n_u)) + np.sqrt(np.log(4 / DELTA) / (2 * n_p)))
    cut = np.argmin((above_u[some] + slack) / above_p[some])
    return float(np.clip(above_u[some][cut] / above_p[some][cut], 1e-3, 1.0))


def class_prior(rows: DataFrame, weights: list[np.ndarray]) -> float:
    """The estimated share of positives of rows(x, positive, half); each half is scored by the other's weights."""
    scored = _margins(rows, weights[::-1], ["positive"])
    bins = F.floor((MOST - F.greatest(F.least("margin", F.lit(MOST - 1e-9)), F.lit(1e-9 - MOST))) * (BINS / (2 * MOST)))
    counts = scored.groupBy(bins.alias("bin")).agg(F.count_if("positive").alias("p"), F.count(F.lit(1)).alias("u")).collect()  # at most BINS
    positive, everything = np.zeros(BINS), np.zeros(BINS)
    for row in counts:
        positive[row.bin], everything[row.bin] = row.p, row.u
    return best_bin(positive, everything)


def non_negative(penalty: np.ndarray, prior: float):
    """The step towards the least non-negative risk."""

    def step(found, w, theta):
        p, u = found
        negative = u.loss_other / u.n - prior * p.loss_other / p.n
        value = prior * p.loss / p.n + max(0.0, negative) + (penalty * w * w).sum() / 2
        first = prior * (p.pull - p.x) / p.n + penalty * w
        second = u.pull / u.n - prior * p.pull / p.n
        curve = (1 - theta) * prior * p.curve / p.n + theta * u.curve / u.n + np.diag(penalty)
        own, other = _solved(curve, -first, -second)
        # theta at which the move would bring the negative risk to 0, and at most 1.
        reach = -(second @ other)
        theta = float(np.clip((negative + second @ own) / reach, 0.0, 1.0)) if reach > 1e-12 else 1.0
        move = own + theta * other
        return value, move, move @ curve @ move + abs(negative) * (0 < theta < 1), theta

    return step


@dataclass
class Model:
    weights: np.ndarray
    prior: float


def train(rows: DataFrame, ridge: float = RIDGE) -> Model | None:
    """The classifier of featured(); None without a positive."""
    rows = rows.where("not held_out")
    halves = {r.half for r in rows.where("positive").select("half").distinct().collect()}
    if not halves:
        return None
    tasks = rows.select(F.spark_partition_id().alias("p")).distinct().count()
    # Where one half has no positive, all rows fit and measure.
    fits = 2 if len(halves) == 2 else 1
    measure = lambda weights: sums(rows, tasks, weights)
    penalties = [_penalty(u, ridge) for _, u in measure([np.zeros(SIZE + 1)] * fits)]
    weights = _descend(measure, [separating(p) for p in penalties])
    prior = class_prior(rows, weights)
    for _ in range(REFINEMENTS):
        # Whatever the scores, the share of positives is at most what they show; better ones show less.
        weights = _descend(measure, [non_negative(p, prior) for p in penalties])
        prior = min(prior, class_prior(rows, weights))
    penalty = _penalty(measure([np.zeros(SIZE + 1)])[0][1], ridge)
    return Model(_descend(measure, [non_negative(penalty, prior)])[0], prior)


def _margins(rows: DataFrame, weights: list[np.ndarray], keep: list[str]) -> DataFrame:
    """rows' columns keep, and the margin; of two weights each half has one."""
    model = sent(rows.sparkSession, weights)

    def run(batches):
        own = np.stack(model(), 1)
        for batch in batches:
            half = batch["half"].to_numpy() if own.shape[1] > 1 else 0
            margins = (_matrix(batch["x"]) @ own)[np.arange(batch.num_rows), half]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), pa.array(margins)], [*keep, "margin"])

    shape = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "half", "x").mapInArrow(run, f"{shape}, margin double")


def score(rows: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """featured() as (doc_id, held_out, score, predicted)."""
    if model is None:
        scored = rows.select("doc_id", "held_out", F.lit(0.0).alias("score"))
    else:
        scored = _margins(rows, [model.weights], ["doc_id", "held_out"])
        scored = scored.select("doc_id", "held_out", (1 / (1 + F.exp(-F.col("margin")))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
