"""Exact byte-pair token counts by rank-synchronous merging of ragged numpy arrays.

Texts are cut into pre-tokens. All new pre-tokens of a batch lie end to end in one symbol array.
Each round finds the lowest merge rank in every pre-token and applies that merge at all its places
in all pre-tokens at once; a pre-token without a merge left is done, and its surviving symbols are
its tokens. Counts of pre-tokens are kept between batches, up to a bound.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calendrix.llm.common import whole_text

OVER, KEPT, SEGMENT = 1024, 400_000, 1 << 22
NONE = np.uint32(0xFFFFFFFF)
#: The pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class MergeTable:
    """The merges of a byte-level BPE tokenizer.json, as arrays."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        vocab = data["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.of_byte = np.array([vocab[s] for s in byte_symbols()], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank = np.argsort(keys, kind="stable").astype(np.uint32)
        self.keys = keys[self.rank]
        self.special = [t["content"] for t in data.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)


def count_symbols(words: list[bytes], table: MergeTable) -> np.ndarray:
    """Symbols of each word after all merges."""
    counts = np.zeros(len(words), np.int64)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    symbols = table.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    rank = np.full(len(symbols), NONE)  # of the pair that starts at each symbol
    if len(symbols) > 1:
        rank[:-1] = np.where(owner[1:] == owner[:-1], table.ranks(symbols[:-1], symbols[1:]), NONE)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[starts, len(owner)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            counts[owner[starts[done]]] = lengths[done]
            going = np.repeat(~done, lengths)
            symbols, owner, rank = symbols[going], owner[going], rank[going]
            lowest, lengths = lowest[~done], lengths[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, lengths)
        # In a run of overlapping pairs (aaaa) every other one merges, from the left.
        places = np.flatnonzero(hit)
        first = np.r_[True, np.diff(places) > 1]
        run_start = np.maximum.accumulate(np.where(first, places, 0))
        places = places[(places - run_start) % 2 == 0]
        symbols[places] = table.merged[rank[places]]
        keep = np.ones(len(symbols), bool)
        keep[places + 1] = False
        at = places - np.arange(len(places))  # where the merged symbols are now
        symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
        changed = np.r_[at, np.maximum(at - 1, 0)]
        inner = changed[changed < len(symbols) - 1]
        rank[changed] = NONE
        same = owner[inner] == owner[inner + 1]
        rank[inner] = np.where(same, table.ranks(symbols[inner], symbols[inner + 1]), NONE)
    return counts


class TokenCounter:
    def __init__(self, spec: str, kept: int = KEPT):
        self.table, self.kept, self.known = MergeTable(spec), kept, {}
        self.pattern, self.boundary = regex.compile(PATTERN), regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.table.special, key=len, reverse=True)))) if self.table.special else None

    def _segments(self, text: str):
        """Pieces of a long text; no pre-token crosses from other characters to white space. A text without white
        space is one piece, as its pre-tokens can't be told before it is read: its memory grows with it."""
        while len(text) > SEGMENT and (cut := self.boundary.search(text, SEGMENT)):
            yield text[: cut.start()]
            text = text[cut.start() :]
        yield text

    def counts(self, texts) -> list[int]:
        """Tokens of each text. Segments are counted in groups of about SEGMENT characters."""
        totals, group, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts = self.special.split(text) if self.special else [text]
            totals[i] += len(parts) - 1
            for segment in (s for part in parts for s in self._segments(part)):
                group.append((i, self.pattern.findall(segment)))
                size += len(segment)
                if size >= SEGMENT:
                    self._add(group, totals)
                    group, size = [], 0
        self._add(group, totals)
        return totals

    def _add(self, group: list[tuple[int, list[str]]], totals: list[int]) -> None:
        if len(self.known) > self.kept:
            self.known = {}
        new = list(set().union(*(words for _, words in group)).difference(self.known))
        self.known.update(zip(new, count_symbols([w.encode("utf-8", "surrogatepass") for w in new], self.table).tolist()))
        for i, words in group:
            totals[i] += sum(map(self.known.__getitem__, words))


def count_tokens(docs: DataFrame, vocabulary: str, over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs(doc_id, text).

    vocabulary is the path of a byte-level BPE tokenizer.json, read on the driver (its size is
    fixed, whatever the corpus). Special tokens written out in a text count as one token each, as
    the tokenizers library has it by default. Null and empty texts have no tokens; repeated rows
    all come back; other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        counter = TokenCounter(spec.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.n_bytes, "n_tokens": counter.counts(pdf.text)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = whole_text(docs)
    counted = docs.select("doc_id", F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")).mapInPandas(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > over)
