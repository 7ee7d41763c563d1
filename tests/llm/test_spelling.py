"""Operator 13 against brute force: all words, and all edits of each."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from tallymill.llm import spelling
from tallymill.llm.spelling import Trie, neighbours

from .conftest import SF

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))


def edits(w, letters=LETTERS):
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
    return (out | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) - {w}


def by_hand(docs):
    count = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            count[w] = count.get(w, 0) + 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    rows = {}
    for w, k in n.items():
        near = [x for x in edits(w) if x in n] if len(w) < 100 else [x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * k else None
        rows[w] = (form, k, len(near), n[form] if form else None)
    out = []
    for w, (form, k, near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out.append((w, form, root, k, near, form_n))
    return sorted(out)


def test_tries_find_all_neighbours():
    rng = random.Random(3)
    for letters, longest, size in (("ab", 9, 400), ("abcÿ", 6, 500), ("abcdefgh", 5, 700)):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(size)})
        some = [w for w in words if rng.random() < 0.7]
        tries = [Trie.of([w.encode("latin-1") for w in x], np.ones(len(x), np.int64)) for x in (words, some)]
        tries = [Trie.read(t.data()) for t in tries]
        left, right = neighbours(*tries)
        found = sorted(zip((words[i] for i in left), (some[i] for i in right), strict=True))
        have = set(some)
        assert found == sorted((w, x) for w in words for x in edits(w, letters) if x in have)


def test_long_words_and_deep_tries():
    base = "ab" * 150_000
    words = sorted([base, base[:-1], base[:1000] + "c" + base[1000:], base[:70_000] + base[70_001:], "x" + base, base[1:], base + "b", "a" * 50, "a" * 51, "a" * 52, *("a" * k for k in range(60, 400))])
    trie = Trie.of([w.encode() for w in words], np.ones(len(words), np.int64))
    left, right = neighbours(trie, trie)
    found = {(words[i], words[j]) for i, j in zip(left, right, strict=True)}
    assert len(found) == len(left)
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and one_edit(a, b)
    assert found == {(a, b) for a in words for b in words if near(a, b)}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def compare(spark, rows, **more):
    found = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == by_hand(rows)


def test_odd_texts_and_many_shards(spark):
    rng = random.Random(5)
    stems = ["colour", "Color", "grüße", "GRÜSSE", "straße", "maïs", "naïve", "écoles", "theatre", "theater", "ab", "abcde", "abcdef", "bcdef", "Abcdeé"]

    def noisy():
        w = rng.choice(stems)
        return rng.choice(sorted(edits(w.lower(), "abé"))) if rng.random() < 0.4 else w

    rows = [(i, "".join(noisy() + rng.choice([" ", ", ", "\n", "1", "日", "Ā", "ß-"]) for _ in range(60))) for i in range(120)]
    long = "".join(rng.choice(LETTERS) for _ in range(200_000))
    rows += [(None, None), (500, None), (501, ""), (502, "  \n"), (None, "abcde abcde abcdef"), (7, "colour"), (7, "colour")] + [(600 + i, long + " x " + long[:-1]) for i in range(4)]
    compare(spark, rows)
    compare(spark, rows, shard=600)


def test_chains_of_forms(spark):
    words = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "abcdefghi": 48, "abcdefghij": 96, "abcdefghik": 96, "zzzzz": 5, "zzzzy": 9}
    rows = [(i, f"{w} ") for i, w in enumerate(w for w, n in words.items() for _ in range(n))]
    compare(spark, rows)


def test_empty_clashing_and_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert spelling.variants(docs.limit(0)).collect() == []
    clash = docs.withColumns({c: F.lit("x") for c in ("word", "n", "shard", "upto", "path", "best", "part", "form", "root")})
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, spelling.variants(clash, shard=9000).collect()), key=lambda r: r[0]) == by_hand(rows)
