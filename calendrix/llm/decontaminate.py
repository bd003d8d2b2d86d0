"""Benchmark decontamination by q-gram filtering in diagonal bands and banded alignment.

Texts are compared as lower-cased words (letters and digits) with single spaces. A benchmark item
of n characters leaks into a document if some stretch of the document is within
k = floor(EDITS * n) edits of it. By the q-gram lemma such a stretch shares at least
n + 1 - q * (k + 1) of the item's q-grams, all on diagonals (document position less item position)
that differ by at most k. Shared q-grams are counted in overlapping bands of diagonals, 2k+1 wide
at every k+1, so that every run of k+1 diagonals lies within one band. Bands that reach the bound
are verified by an alignment restricted to the band's diagonals. q is Q, or SHORT_Q for items too
short for that bound. Items under Q characters allow no edits, and are found where they stand as
whole words: padded by spaces they are a single q-gram of their own length.

Shared q-grams are worked off in slices of about HITS, of which only the distinct (band, q-gram)
pairs of bands still open are kept, so that repetitive texts need no more memory than others.

The items' texts are sent to all executors, normalised there before and indexed there after: a set
of up to MAX_GRAMS characters goes in one pass over the documents, a larger one in several passes,
each of that bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import sent, sliced, texts_of, whole_text

Q, SHORT_Q, EDITS, MAX_GRAMS = 16, 8, 0.05, 2_000_000
#: Shared q-grams looked at together.
HITS = 250_000
#: Characters of normalised text looked at together.
CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def normalise(text: str) -> str:
    """Lower case, with everything but letters and digits as single spaces."""
    low = text.lower()
    table = {c: " " for c in set(low) if not c.isalnum()}
    return " ".join(low.translate(str.maketrans(table)).split())


def gram_codes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position, by doubling; len - q + 1 values."""
    code, width = points.astype(np.uint64) + np.uint64(1), 1
    code = code * BASE
    code ^= code >> np.uint64(29)
    while width < q:
        step = min(width, q - width)
        code = code[:-step] * BASE + (code[step:] ^ (code[step:] >> np.uint64(31)))
        width += step
    return code


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def edit_budget(n: int, edits: float = EDITS) -> int:
    """Edits allowed for an item of n characters."""
    return int(edits * n)


def gram_length(n: int, q: int = Q, short_q: int = SHORT_Q, edits: float = EDITS) -> int:
    """The q of an item of n characters, for which the lemma's bound is 1 at least; an item under q
    characters is a q-gram itself, with a space at each end."""
    if n < q:
        return n + 2
    budget = edit_budget(n, edits) + 1
    return next(size for size in (q, short_q, *range(short_q, 0, -1)) if size * budget <= n)


def banded_distance(item: np.ndarray, region: np.ndarray, first: int, last: int, budget: int) -> tuple[int, int]:
    """(edits, end in region) of the best stretch of region for the whole item, among alignments
    on diagonals first to last (region position less item position); budget + 1 if none."""
    width, none = last - first + 1, budget + 1
    lane = np.arange(width)
    # Before the first character of the item, a stretch may start on any diagonal of the band.
    row = np.where((lane + first >= 0) & (lane + first <= len(region)), 0, none)
    for i, symbol in enumerate(item):
        at = i + first + lane  # position in region of the character that would be matched
        inside = (at >= 0) & (at < len(region))
        same = np.zeros(width, bool)
        same[inside] = region[at[inside]] == symbol
        new = np.where(inside, row + ~same, none)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)  # a character of the item left out
        new = np.minimum.accumulate(new - lane) + lane  # characters of the region left out
        new[(at + 1 < 0) | (at + 1 > len(region))] = none
        row = np.minimum(new, none)
        if row.min() > budget:
            return none, 0
    best = int(row.argmin())
    return int(row[best]), len(item) + first + best


@dataclass
class Grams:
    """The q-grams of one length: sorted codes with the item and position of each."""

    q: int
    codes: np.ndarray
    item: np.ndarray
    at: np.ndarray

    def __post_init__(self):
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.codes >> np.uint64(42)] = True

    def slices(self, codes: np.ndarray):
        """(position, item, item position) of all q-grams that agree, by position, in slices of
        about HITS; the position from which the next slice has hits comes with each."""
        place = np.flatnonzero(self.maybe[codes >> np.uint64(42)])
        low = np.searchsorted(self.codes, codes[place], "left")
        many = np.searchsorted(self.codes, codes[place], "right") - low
        place, low, many = place[many > 0], low[many > 0], many[many > 0]
        before, begin = np.r_[0, np.cumsum(many)], 0
        while begin < len(place):
            end = max(begin + 1, int(np.searchsorted(before, before[begin] + HITS, "right")) - 1)
            own = many[begin:end]
            which = np.repeat(low[begin:end], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            yield np.repeat(place[begin:end], own), self.item[which], self.at[which], int(place[end]) if end < len(place) else None
            begin = end


class Index:
    """Benchmark items (id, normalised text) with their q-grams, by q-gram length."""

    def __init__(self, rows, q: int = Q, short_q: int = SHORT_Q, edits: float = EDITS):
        rows = [(item_id, text) for item_id, text in rows if text]
        self.ids = [item_id for item_id, _ in rows]
        self.items = [_points(text if len(text) >= q else f" {text} ") for _, text in rows]
        self.exact = np.array([len(text) < q for _, text in rows], bool)
        self.budget = np.array([edit_budget(len(text), edits) if len(text) >= q else 0 for _, text in rows], np.int64)
        self.size = np.array([len(points) for points in self.items], np.int64)
        lengths = np.array([gram_length(len(text), q, short_q, edits) for _, text in rows], np.int64)
        self.need = self.size + 1 - lengths * (self.budget + 1)
        self.grams = []
        for length in sorted(set(lengths.tolist())):
            own = np.flatnonzero(lengths == length)
            codes = [gram_codes(self.items[i], length) for i in own]
            item, at = np.repeat(own, [len(c) for c in codes]), np.concatenate([np.arange(len(c)) for c in codes])
            codes = np.concatenate(codes)
            order = np.argsort(codes, kind="stable")
            self.grams.append(Grams(length, codes[order], item[order], at[order]))

    def candidates(self, points: np.ndarray, starts: np.ndarray, solved: set[int]):
        """(rows, q): rows are arrays (text, item, band, shared q-grams) of the bands that reach their
        item's bound, in parts by position. starts: where each text begins in points; solved: text *
        items + item where nothing better can follow, to which the caller may add between parts."""
        for grams in self.grams:
            if len(points) < grams.q:
                continue
            open_rows = np.zeros((0, 4), np.int64)
            for pos, item, at, coming in grams.slices(gram_codes(points, grams.q)):
                text = np.searchsorted(starts, pos, "right") - 1
                if solved:
                    left = ~np.isin(text * len(self.ids) + item, list(solved))
                    pos, item, at, text = pos[left], item[left], at[left], text[left]
                k, diagonal = self.budget[item], pos - at
                # Band b covers diagonals b*(k+1) to b*(k+1)+2k; a diagonal lies in one or two bands.
                upper = diagonal // (k + 1)
                two = diagonal - (upper - 1) * (k + 1) <= 2 * k
                rows = np.stack([np.r_[text, text[two]], np.r_[item, item[two]], np.r_[upper, upper[two] - 1], np.r_[at, at[two]]], axis=1)
                rows = _distinct(np.concatenate([open_rows, rows]))  # repeats of one q-gram count once
                if coming is None:
                    closed = np.ones(len(rows), bool)
                else:  # hits to come lie on diagonals from coming - size on
                    k = self.budget[rows[:, 1]]
                    closed = rows[:, 2] * (k + 1) + 2 * k < coming - self.size[rows[:, 1]]
                done, open_rows = rows[closed], rows[~closed]
                if len(done):
                    first = np.flatnonzero(np.r_[True, (done[1:, :3] != done[:-1, :3]).any(axis=1)])
                    count = np.diff(np.r_[first, len(done)])
                    reached = count >= self.need[done[first, 1]]
                    yield np.c_[done[first[reached], :3], count[reached]], grams.q


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Sorted distinct rows."""
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows


def _windows(texts, index: Index):
    """(row, offset, text): long texts in overlapping windows, in which every stretch is whole."""
    overlap = 2 * max(map(len, index.items), default=0)
    for row, text in enumerate(texts):
        clean = f" {normalise(text)} "
        for offset in range(0, max(len(clean) - overlap, 1), CHUNK):
            yield row, offset - 1, clean[offset : offset + CHUNK + overlap]


def leaks_of(texts, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, start, end, edits) of the leaks of a batch of texts."""
    found, group, size = {}, [], 0
    gap = max((grams.q for grams in index.grams), default=1)

    def search():
        points = _points(("\0" * gap).join(text for *_, text in group))
        starts = np.cumsum([0, *(len(text) + gap for *_, text in group[:-1])])
        solved: set[int] = set()
        for bands, q in index.candidates(points, starts, solved):
            least = (index.size[bands[:, 1]] + 1 - q - bands[:, 3] + q - 1) // q  # each edit costs q q-grams at most
            for at in np.lexsort((bands[:, 2], least)):
                own, number, band = bands[at, :3].tolist()
                row, offset, text = group[own]
                item, k, begin = index.items[number], int(index.budget[number]), int(starts[own])
                first, exact = band * (k + 1) - begin, bool(index.exact[number])
                best = found.get((row, number))
                # Of equals the first end counts: a band that cannot do better is passed over.
                if best and (least[at], len(item) + first + offset - exact) >= (best[2], best[1]):
                    continue
                start = max(0, first)
                region = points[begin + start : begin + min(first + 2 * k + len(item) + 1, len(text))]
                edits, end = banded_distance(item, region, first - start, first - start + 2 * k, k)
                if edits <= k:
                    end += start + offset - exact  # the spaces beside a short item are not its own
                    got = (max(0, end - len(item) + 2 * exact), end, edits)
                    if best is None or (edits, end) < (best[2], best[1]):
                        found[row, number] = got
                        if edits == 0:  # bands come by position
                            solved.add(own * len(index.ids) + number)

    for window in _windows(texts, index):
        group.append(window)
        size += len(window[2])
        if size >= CHUNK:
            search()
            group, size = [], 0
    if group and index.grams:
        search()
    return [(*key, *value) for key, value in found.items()]


def _item_groups(benchmark: DataFrame, max_grams: int):
    """Groups of normalised items of at most max_grams characters (or one item) each, read from
    the cluster one group at a time."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=pdf.text.map(normalise))

    kind = benchmark.schema["item_id"].dataType.simpleString()
    texts = benchmark.select("item_id", whole_text(benchmark).alias("text")).mapInPandas(run, f"item_id {kind}, text string")
    group, size = [], 0
    for row in texts.where("text != ''").toLocalIterator():
        if group and size + len(row.text) > max_grams:
            yield group
            group, size = [], 0
        group.append((row.item_id, row.text))
        size += len(row.text)
    if group:
        yield group


def _indexes(spark, benchmark: DataFrame, max_grams: int, **settings):
    """For each group of items, a function that gives its index in tasks, made once in each worker."""
    for group in _item_groups(benchmark, max_grams):
        shared, made = sent(spark, group), []

        def index(shared=shared, made=made):
            if not made:
                made.append(Index(shared(), **settings))
            return made[0]

        yield index


def find_leaks(docs: DataFrame, benchmark: DataFrame, max_grams: int = MAX_GRAMS, **settings) -> DataFrame:
    """(doc_id, item_id, start, end, edits): items of benchmark(item_id, text) found in
    docs(doc_id, text), one row for each pair, with the place in the normalised text.

    end is where the best stretch ends (of equals the first) and start is end less the item's
    length. Items without letters and digits (null and empty ones too) are in no document; null
    and empty documents have no leaks; repeated documents and items each give their rows; other
    columns are not read. settings: q, short_q and edits of Index.
    """
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_kind}, item_id {item_kind}, start bigint, end bigint, edits int"
    texts = docs.select("doc_id", whole_text(docs).alias("text"))
    out = None
    for index in _indexes(docs.sparkSession, benchmark, max_grams, **settings):

        def run(batches, index=index):
            own = index()
            for pdf in batches:
                rows = [(pdf.doc_id.iat[row], own.ids[number], *rest) for row, number, *rest in leaks_of(pdf.text, own)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])

        part = texts.mapInPandas(run, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, max_grams: int = MAX_GRAMS, **settings) -> DataFrame:
    """docs, all its columns, without the rows whose text has a leak; rows are judged one by one,
    so that a clean row stays beside a leaked one of its doc_id. Nothing is shuffled."""
    for index in _indexes(docs.sparkSession, benchmark, max_grams, **settings):

        def run(batches, index=index):
            own = index()
            for batch in sliced(batches):
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in leaks_of(texts_of(batch), own)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
