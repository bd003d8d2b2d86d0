import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from calendrix.llm import token_counts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def texts():
    rng = random.Random(1)
    chars = "aab  eth\n\t\x0b\x1c\x1f\x85\xa0 ​'’sdtrevml.,!?1²٣½éÉß🙂漢字नी́"
    fixed = ["", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", " \n  x", "a" * 101, " " * 33 + "x", "!!" * 70, "  ", "x \n"]
    return fixed + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 80))) for _ in range(3000)]


def test_counts_are_the_librarys(library):
    counter = token_counts.TokenCounter(open(VOCABULARY, encoding="utf-8").read(), kept=50)
    want = [len(e.ids) for e in library.encode_batch(texts(), add_special_tokens=False)]
    assert counter.counts(texts()) == want


def test_segments_and_long_words(library, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 100)
    rng = random.Random(2)
    long = ["".join(rng.choice("abc  \n,é1") for _ in range(5000)), "".join(rng.choice("abcdefgh") for _ in range(5000)), " \n" * 400]
    counter = token_counts.TokenCounter(open(VOCABULARY, encoding="utf-8").read())
    assert counter.counts(long) == [len(library.encode(t, add_special_tokens=False).ids) for t in long]


def test_rows(spark, library):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (3, ""), (None, "x " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS n_tokens", "9 AS n_bytes")
    got = sorted(map(tuple, token_counts.count_tokens(docs, VOCABULARY).collect()), key=str)
    want = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(docs.limit(0), VOCABULARY).isEmpty()
