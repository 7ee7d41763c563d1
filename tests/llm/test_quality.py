"""Operator 6: held-out accuracy, and the votes against a plain count of them."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallymill.llm import quality
from tallymill.llm.shared import text_bytes

from .conftest import SF

GOOD = "the cat and the dog went to the house of a friend and it was good".split()


def synthetic(n):
    rng = np.random.default_rng(3)
    out = []
    for i in range(n):
        words = rng.choice(GOOD, 40)
        out.append((i, " ".join(words) + "." if i % 3 else " | ".join(w.upper() + "!!" for w in words), "en", f"s{i % 4}"))
    return out


def test_held_out_accuracy(spark, make_docs):
    rows = synthetic(240)
    docs = make_docs(rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    found = quality.classify(docs, labels).collect()
    assert len(found) == 240
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in found if r["held_out"]]) > 0.97


def test_documents_of_the_fixture(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = quality.classify(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_held_out_labels_are_not_looked_at(spark, make_docs):
    docs = make_docs(synthetic(120))
    true = [(i, int(i % 3 > 0)) for i in range(120)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in true]
    a, b = (sorted(map(tuple, quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (true, turned))
    assert a == b


def test_votes_by_brute_force():
    texts = [t for _, t, _, _ in synthetic(90)]
    voters = quality.Voters(texts, [i % 2 for i in range(90)])
    data, offsets = text_bytes(pa.array(texts[:20]))
    found = voters.score(data, offsets, block=7)
    for i in range(20):
        own, bounds = text_bytes(pa.array(texts[i : i + 1]))
        v = voters._unit(quality.terms(own, bounds, voters.rarity) @ voters.basis)[0]
        cosines = sorted(((float(v @ w), y) for w, y in zip(voters.vectors, voters.label, strict=True)), reverse=True)[: quality.NEAREST]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in cosines]
        want = (sum(w * y for w, (_, y) in zip(weights, cosines, strict=True)) + quality.PRIOR * voters.share) / (sum(weights) + quality.PRIOR)
        assert abs(found[i] - want) < 1e-6


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0), (7, 1, 1)], "doc_id long, quality int, toxic int")
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("quality", "score", "held_out")})
    rows = quality.classify(clash, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(odd_docs.limit(0), labels).collect() == []
    assert {r["score"] for r in quality.classify(odd_docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= odd_docs.count()
