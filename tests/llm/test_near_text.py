"""Operator 5 against all pairs."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallymill.llm import near_text, shared

from .conftest import SF


def grams(text, n=5):
    words = (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").split()
    words = [w for w in "".join(c if c not in "\t\n\r\x0b\x0c" else " " for c in (text or "").lower()).split(" ") if w]
    return {" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def all_pairs(rows, similarity=0.8):
    """n_links and component of each row (doc_id, text) with distinct doc_ids."""
    sets = [grams(t) for _, t in rows]
    ids = [i for i, _ in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) >= similarity * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if both / (len(sets[a]) + len(sets[b]) - both) >= similarity:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: (links[k], least[find(k)]) for k, i in enumerate(ids)}


def families(seed=1, n=220):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows[-40:])[1].split()
            for _ in range(rng.choice((0, 0, 1, 2, 3, 8))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice((0, 1, 3, 4, 5, 6, 20, 80, 200)))]
        rows.append((k, " ".join(words)))
    return rows


def compare(docs, rows):
    want = all_pairs(rows)
    found = near_text.link(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["n_links"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_all_pairs_of_made_families(spark, make_docs):
    rows = families()
    compare(make_docs([(i, t, "en", "a") for i, t in rows]), rows)


def test_fixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    compare(docs, [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_groups_are_cut_into_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 7)
    rng = random.Random(4)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    rows = []
    for k in range(60):
        words = base[:]
        for _ in range(rng.choice((0, 1, 2, 3))):
            words[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append((k, " ".join(words)))
    compare(make_docs([(i, t, "en", "a") for i, t in rows]), rows)


def test_bands_reach_their_recall():
    for s, recall, most in ((0.8, 0.9999, 128), (0.5, 0.99, 300), (0.9, 0.999, 64)):
        bands, rows = near_text.choose_bands(s, recall, most)
        assert 1 - (1 - s**rows) ** bands >= recall and bands * rows <= most
    rng = np.random.default_rng(0)
    hits = 0
    for k in range(200):  # pairs at 0.8: 100 words, one of the shared 5-grams lost in 9
        words = [f"v{rng.integers(10**6)}" for _ in range(94)]
        other = words[:-5] + [f"z{k}{i}" for i in range(5)]
        _, _, band, _ = near_text.sign(pa.array([" ".join(words), " ".join(other)]), *near_text.choose_bands(0.8, 0.9999, 128))
        hits += (band[0] == band[1]).any()
    assert hits == 200


def test_intersections_by_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(20)]
    found = near_text.intersections(sets, step=7)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert found[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("key", "bands", "unit", "component", "size", "copies", "row_hash", "_hash")})
    rows = near_text.link(clash).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_links"] == 0 and r["kept"]
    same = [r for r in rows if r["n_links"] == 2]
    assert len(same) == 3 and {r["component_id"] for r in same} == {4}
    assert near_text.link(odd_docs.limit(0)).collect() == []


def test_one_of_each_stays(spark, odd_docs, make_docs):
    kept = near_text.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = sorted(str(r["text"]) for r in kept.collect())
    assert texts == sorted({str(r["text"]) for r in odd_docs.collect()})
    rows = families(7)
    want = all_pairs(rows)
    kept = near_text.one_of_each(make_docs([(i, t, "en", "a") for i, t in rows]))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
