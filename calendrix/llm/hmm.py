"""A hidden Markov language model, trained by Baum-Welch over all training documents.

Symbols. The VOCABULARY most frequent training tokens are symbols of their own, as is the end of
the text; every other word belongs to one of CLASSES word classes (by length and last byte), and
each class is a symbol. The HMM gives the probability of the symbol sequence; a class symbol's
word then costs its smoothed share of the class, with one share left for all unseen words. Both
factors are proper distributions, so the score is the log probability of the whole text.

Training. Word counts cover all training documents (counted in tasks, summed by a shuffle). Texts
become arrays of symbols once, written to shared storage; each Baum-Welch round reads them and
sums every partition's expected counts by symbol. The first parameters come from a bounded sample
of SEED_DOCS texts of up to SEED_TOKENS tokens, so that few full rounds are needed. Shares of rare words meet their texts by a
join on the word. What reaches the driver is bounded by VOCABULARY, CLASSES and STATES.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import durable, sent, whole_text, written

STATES, VOCABULARY, CLASSES, ROUNDS = 8, 50_000, 256, 2
SEED_DOCS, SEED_TOKENS, SEED_ROUNDS = 400, 5000, 12
FOLDS, HELD_OUT = 5, 1
#: Tokens whose forward and backward tables are held at once.
BLOCK = 250_000
#: Distinct words counted in a task before they are handed on.
FLUSH = 100_000
#: Texts that a task turns into symbols at a time.
SLICE = 500


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words between ASCII white space."""
    return text.encode("utf-8", "replace").lower().split()


def word_class(word: str) -> int:
    """Class of a rare word, from its length and its last character."""
    return (min(len(word), 31) // 4 * 31 + ord(word[-1])) % CLASSES


def _class_of() -> Column:
    """word_class() of column word."""
    last = F.ascii(F.right("word", F.lit(1)))
    return (F.floor(F.least(F.char_length("word"), F.lit(31)) / 4).cast("int") * 31 + last) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts(text)."""

    def run(batches):
        seen: Counter = Counter()

        def rows():
            return pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

        for pdf in batches:
            for text in pdf.text:
                seen.update(words_of(text))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return texts.mapInPandas(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Lexicon:
    """symbols: word to symbol; 0 is the end, 1 to CLASSES the classes, then the frequent words."""

    symbols: dict[bytes, int]
    counts: np.ndarray  # training count of each symbol
    tokens: int  # N: training tokens, ends included
    kinds: int  # V: distinct training tokens, the end included

    def log10_base(self, c):
        return np.log10((np.asarray(c) + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def _slices(batches):
    """The batches in parts of up to SLICE rows, so that what is made of one is handed on first."""
    for pdf in batches:
        for at in range(0, len(pdf), SLICE):
            yield pdf.iloc[at : at + SLICE]


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs(row, doc_id, train, text) with n tokens, symbols (16-bit numbers, the end included) and
    rare (the words that are no symbols of their own, divided by spaces) instead of text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon.symbols)

    def run(batches):
        symbols = shared.value
        for pdf in _slices(batches):
            coded, rare = [], []
            for text in pdf.text:
                own = words_of(text)
                ids = list(map(symbols.get, own))
                others = [i for i, x in enumerate(ids) if x is None]
                names = [own[i].decode() for i in others]
                for i, word in zip(others, names):
                    ids[i] = 1 + word_class(word)
                rare.append(" ".join(names) or None)
                coded.append(np.array([*ids, 0], np.uint16).tobytes())
            yield pdf[["row", "doc_id", "train"]].assign(n=[len(x) // 2 for x in coded], symbols=coded, rare=rare)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(run, f"row bigint, doc_id {kind}, train boolean, n bigint, symbols binary, rare string")


@dataclass
class Hmm:
    start: np.ndarray  # (K)
    moves: np.ndarray  # (K, K)
    emits: np.ndarray  # (K, symbols)

    @staticmethod
    def of_counts(start, moves, emits, prior) -> "Hmm":
        """Smoothed parameters of expected counts; prior is a distribution over symbols."""
        k = len(start)
        emits = emits + 20.0 * prior
        return Hmm((start + 1) / (start + 1).sum(), (moves + 1) / (moves + 1).sum(1, keepdims=True), emits / emits.sum(1, keepdims=True)) if k else None


def _blocks(sequences: list[np.ndarray]):
    """(indices, symbols by time, number of texts at each time): texts longest first, of about
    BLOCK tokens in all; at each time only the texts that are still going on take part."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        size, end = 0, at
        while end < len(order) and (end == at or size + len(sequences[order[end]]) <= BLOCK):
            size += len(sequences[order[end]])
            end += 1
        own = order[at:end]
        lengths = np.array([len(sequences[i]) for i in own])
        going = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        begin = np.r_[0, np.cumsum(going)]
        flat = np.empty(begin[-1], sequences[own[0]].dtype)
        for j, i in enumerate(own):
            flat[begin[: lengths[j]] + j] = sequences[i]
        yield own, flat, begin
        at = end


def log_likelihoods(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each sequence by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    columns = np.ascontiguousarray(model.emits.T)
    for own, flat, begin in _blocks(sequences):
        total = np.zeros(len(own))
        alpha = np.repeat(model.start[None, :], len(own), 0)
        for t in range(len(begin) - 1):
            n = begin[t + 1] - begin[t]
            alpha = (alpha if t == 0 else alpha[:n] @ model.moves) * columns[flat[begin[t] : begin[t + 1]]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            total[:n] += np.log(scale)
        out[own] = total
    return out


def _spans(begin: np.ndarray) -> list[tuple[int, int]]:
    """Times from and to of consecutive pieces of a block, each of up to BLOCK tokens: a block of
    more is one long text."""
    spans, at, steps = [], 0, len(begin) - 1
    while at < steps:
        end = max(at + 1, int(np.searchsorted(begin, begin[at] + BLOCK, side="right")) - 1)
        spans.append((at, end))
        at = end
    return spans


def _forward(model: Hmm, seen: np.ndarray, begin: np.ndarray, before: np.ndarray | None):
    """Scaled forward probabilities and scales over one span; before: those of the step that precedes it."""
    alpha, scale = np.empty_like(seen), np.empty(len(seen))
    for t in range(len(begin) - 1):
        here, n = slice(begin[t], begin[t + 1]), begin[t + 1] - begin[t]
        a = (model.start if before is None else before[:n] @ model.moves) * seen[here]
        scale[here] = a.sum(1)
        before = alpha[here] = a / scale[here][:, None]
    return alpha, scale


def expected_counts(model: Hmm, sequences: list[np.ndarray]):
    """(start, moves, emits) counts expected under the model: one Baum-Welch expectation step.

    Of a block's spans only the forward probabilities at their ends are held; each span's own are made
    again on the way back. So a text of any length needs the memory of BLOCK tokens, and a block of one
    span is passed over once.
    """
    k, symbols = model.emits.shape
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((symbols, k))
    columns = np.ascontiguousarray(model.emits.T)
    for _, flat, begin in _blocks(sequences):
        spans = _spans(begin)
        part = lambda span: (flat[begin[span[0]] : begin[span[1]]], begin[span[0] : span[1] + 1] - begin[span[0]])  # noqa: E731, B023
        ends: list[np.ndarray | None] = [None]
        for span in spans[:-1]:
            own, times = part(span)
            alpha, _ = _forward(model, columns[own], times, ends[-1])
            ends.append(alpha[times[-2] :].copy())
        message = None  # from the step after the span
        for span, before in zip(reversed(spans), reversed(ends)):
            own, times = part(span)
            seen = columns[own]
            alpha, scale = _forward(model, seen, times, before)
            for t in range(len(times) - 2, -1, -1):
                here = slice(times[t], times[t + 1])
                beta = np.ones((times[t + 1] - times[t], k))
                if message is not None:
                    n = len(message)
                    moves += alpha[times[t] : times[t] + n].T @ message
                    beta[:n] = message @ model.moves.T
                message = seen[here] * beta / scale[here][:, None]
                alpha[here] *= beta  # from here on the probabilities of the states, given the text
            if before is None:
                start += alpha[: times[1]].sum(0)
            for state in range(k):
                emits[:, state] += np.bincount(own, alpha[:, state], symbols)
    return start, moves * model.moves, emits.T


def _sequences(pdf) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint16) for x in pdf.symbols]


def baum_welch_round(coded: DataFrame, model: Hmm, prior: np.ndarray) -> Hmm:
    """The model re-estimated from the expected counts of all rows of coded(symbols)."""
    shared = sent(coded.sparkSession, model)
    k, symbols = model.emits.shape

    def run(batches):
        hmm, totals = shared(), None
        for pdf in batches:
            got = expected_counts(hmm, _sequences(pdf))
            if totals is None:
                totals = got
            else:
                for total, more in zip(totals, got):
                    total += more
        if totals is not None:
            start, moves, emits = totals
            yield pd.DataFrame({"part": [-1, *(-2 - i for i in range(k))], "mass": [start, *moves]})
            used = np.flatnonzero(emits.sum(0))
            for at in range(0, len(used), FLUSH // k):
                some = used[at : at + FLUSH // k]
                yield pd.DataFrame({"part": some.astype(np.int32), "mass": list(emits[:, some].T)})

    parts = coded.select("symbols").mapInPandas(run, "part int, mass array<double>")
    sums = parts.groupBy("part").agg(F.array(*[F.sum(F.get("mass", F.lit(i))) for i in range(k)]).alias("mass"))
    start, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, symbols))
    for row in sums.toPandas().itertuples():  # at most 1 + STATES + symbols rows
        if row.part == -1:
            start = np.array(row.mass)
        elif row.part < -1:
            moves[-2 - row.part] = row.mass
        else:
            emits[:, row.part] = row.mass
    shared.unpersist()
    return Hmm.of_counts(start, moves, emits, prior)


def _first_model(sample: list[np.ndarray], prior: np.ndarray, states: int, rounds: int) -> Hmm:
    """Slow-moving states with random leanings, refined on a bounded sample."""
    rng = np.random.default_rng(0)
    moves = np.full((states, states), 0.05 / max(1, states - 1)) + np.eye(states) * 0.95
    emits = prior * rng.gamma(2.0, 0.5, (states, len(prior)))
    model = Hmm(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    for _ in range(rounds if sample else 0):
        model = Hmm.of_counts(*expected_counts(model, sample), prior)
    return model


def _fit_lexicon(counts: DataFrame, ends: int, vocabulary: int) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and (word, c, class, class_c, class_v) of the words outside it."""
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    frequent = counts.orderBy(F.desc("c"), "word").limit(vocabulary).toPandas()  # bounded
    symbols = {w.encode("utf-8", "replace"): 1 + CLASSES + i for i, w in enumerate(frequent.word)}
    of_symbol = np.r_[float(ends), np.zeros(CLASSES), frequent.c.to_numpy(float)]
    listed = counts.sparkSession.createDataFrame(frequent[["word"]], "word string")
    tail = counts.join(F.broadcast(listed), "word", "left_anti").withColumn("class", _class_of())
    sizes = tail.groupBy("class").agg(F.sum("c").alias("class_c"), F.count(F.lit(1)).alias("class_v")).toPandas()  # CLASSES rows
    of_symbol[1 + sizes["class"].to_numpy(int)] = sizes.class_c
    return Lexicon(symbols, of_symbol, n_words + ends, n_kinds + (ends > 0)), tail


def _rare_sums(coded: DataFrame, tail: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(row, rare_known, rare_base, rare_share) of each row with rare words: how many were seen in
    training, the log10 of their unigram probabilities and of their shares of their classes."""
    sizes = durable(tail.groupBy("class").agg(F.sum("c").alias("class_c"), F.count(F.lit(1)).alias("class_v")))
    each = coded.where("rare is not null").select("row", F.explode(F.split("rare", " ")).alias("word"))
    met = each.join(tail.select("word", "c"), "word", "left").withColumn("class", _class_of())
    met = met.join(F.broadcast(sizes), "class", "left")  # CLASSES rows at most
    c, class_c, class_v = (F.coalesce(x, F.lit(0)) for x in ("c", "class_c", "class_v"))
    return met.groupBy("row").agg(
        F.count("c").alias("rare_known"),
        F.sum(F.log10((c + 0.5) / F.lit(lexicon.tokens + 0.5 * (lexicon.kinds + 1)))).alias("rare_base"),
        F.sum(F.log10((c + 0.5) / (class_c + 0.5 * (class_v + 1)))).alias("rare_share"),
    )


def score(docs: DataFrame, states: int = STATES, vocabulary: int = VOCABULARY, rounds: int = ROUNDS) -> DataFrame:
    """Scores of docs(doc_id, text) by a model learnt from its rows that are not held out.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), log10. A text
    has its words and one end; null and empty texts are an end alone. base_score is the smoothed
    unigram model. Repeated rows each count and come back; a null doc_id is a training row. With
    no training rows every token is unseen. Other columns are not read. Symbols have 16 bits, so
    vocabulary is at most 65,535 less CLASSES.
    """
    if vocabulary + CLASSES >= 1 << 16:
        raise ValueError(f"a vocabulary of {vocabulary} words and {CLASSES} classes does not fit 16 bits")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (~held_out()).alias("train"), whole_text(docs).alias("text"))
    trained = texts.where("train").select("text")
    counts = written(word_counts(trained))
    lexicon, tail = _fit_lexicon(counts, trained.count(), vocabulary)
    prior = (lexicon.counts + 0.5) / (lexicon.counts + 0.5).sum()

    coded = written(encode(texts, lexicon))  # row numbers hold from here on
    learn = coded.where("train")
    first = learn.where(F.col("n") <= SEED_TOKENS).select("symbols").orderBy(F.xxhash64("symbols")).limit(SEED_DOCS)
    model = _first_model(_sequences(first.toPandas()), prior, states, SEED_ROUNDS)
    for _ in range(rounds):
        model = baum_welch_round(learn, model, prior)

    shared = sent(docs.sparkSession, (model, np.where(lexicon.counts > 0, 1, 0), lexicon.log10_base(lexicon.counts)))

    def run(batches):
        hmm, known, base = shared()
        own = np.arange(len(known)) > CLASSES
        own[0] = True
        known, base = np.where(own, known, 0), np.where(own, base, 0.0)
        for pdf in batches:
            parts = _sequences(pdf)
            yield pdf[["row", "doc_id", "train", "n"]].assign(
                known=[int(known[x].sum()) for x in parts], base=[base[x].sum() for x in parts], path=log_likelihoods(hmm, parts) / np.log(10)
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    paths = coded.drop("rare").mapInPandas(run, f"row bigint, doc_id {kind}, train boolean, n bigint, known bigint, base double, path double")
    rare = _rare_sums(coded, tail, lexicon)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return paths.join(rare, "row", "left").select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        F.col("n").alias("n_tokens"),
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(int(lexicon.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"),
        (F.col("path") + zero("rare_share")).alias("score"),
    )
