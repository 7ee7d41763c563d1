"""Operator 10 against the library."""

import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tallymill.llm import token_counts

from .conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_odd_strings():
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "é", "ß", "\n", "日本", "🙂", "x́", "▁", "<s>", "</s>", "<0x0A>", "in", "er", "tion", "ation", "1", "12", "000", "...", "aaaa", " " * 18, "İ", "st", "ess", "\t", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + t for k in range(70) for t in ("", "a", "the", "日", "\n")]
    texts += ["a" * 500, "the" * 900, "x" * 3 + " " * 400 + "y", "日" * 300, "▁" * 33]
    want = [len(x) for x in LIBRARY.encode(texts)]
    for chunk, most in ((192, 500_000), (7, 500_000), (16, 1000)):
        found = token_counts.Counter(PATH, chunk=chunk, most=most, most_points=20_000).count(texts)
        assert found.tolist() == want


def test_long_texts_without_spaces():
    rng = random.Random(2)
    words = "the quick brown fox jumps over lazy dogs and every other thing".split()
    texts = ["a" * 30_000, "abcde" * 5000, "".join(rng.choice(words) for _ in range(4000)), "".join(chr(rng.randrange(33, 127)) for _ in range(8000)), "x 1" + "ab" * 7000 + " y"]
    want = [len(x) for x in LIBRARY.encode(texts)]
    for chunk in (192, 5):
        assert token_counts.Counter(PATH, chunk=chunk).count(texts).tolist() == want


def test_long_texts_in_parts():
    rng = random.Random(3)
    parts = ["a", "the", "ing", " ", "  ", "   ", "▁", " ▁ ", "é", "\n", "日本", "🙂", " " * 40, "abcdefgh" * 6]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 400))) for _ in range(300)]
    texts += [" " * 100, "x" * 100, "x" * 70 + " ", "x" * 70 + "  ", " " * 70 + "x", "x " * 99, " x" * 99]
    want = [len(x) for x in LIBRARY.encode(texts)]
    for most in (1, 7, 50):
        counts = token_counts.Counter(PATH, most_points=most)
        cut = [list(counts.parts(t)) for t in texts]
        assert [len(p) and sum(map(len, LIBRARY.encode(p))) for p in cut] == want
        assert all(all(p) for t, p in zip(texts, cut, strict=True) if t)
    assert token_counts.Counter(PATH, chunk=16, most_points=50).count(texts[:10] + texts[-7:]).tolist() == want[:10] + want[-7:]


def test_memory_of_one_text():
    """A long text's parts are short: what counting takes doesn't grow with the text."""
    counts = token_counts.Counter(PATH, most_points=10_000)
    text = "the quick brown fox " * 4_000
    assert max(map(len, counts.parts(text))) <= 10_000
    assert counts.count([text, "a", text]).tolist() == [len(LIBRARY.encode(text)), len(LIBRARY.encode("a")), len(LIBRARY.encode(text))]


def test_scan_is_composition():
    rng = np.random.default_rng(4)
    to, gain = rng.integers(0, 3, (13, 3)), rng.integers(0, 9, (13, 3))
    upto, total = token_counts.compose(to, gain)
    for first in range(3):
        at, sum_ = first, 0
        for k in range(13):
            sum_ += gain[k, at]
            at = to[k, at]
            assert (upto[k, first], total[k, first]) == (at, sum_)


def test_documents(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(map(tuple, token_counts.token_counts(docs, PATH).collect()), key=str)
        want = []
        for r in docs.collect():
            n = len(LIBRARY.encode(r["text"] or ""))
            want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 4096))
        assert rows == sorted(want, key=str)


def test_empty_and_clashing(odd_docs):
    assert token_counts.token_counts(odd_docs.limit(0), PATH).collect() == []
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("n_bytes", "n_tokens", "over_limit")})
    assert token_counts.token_counts(clash, PATH).count() == odd_docs.count()


def test_nothing_but_nulls():
    assert np.array_equal(token_counts.Counter(PATH).count([None, "", None]), [0, 0, 0])
