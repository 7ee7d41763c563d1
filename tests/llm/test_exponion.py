"""Operator 12 against plain k-means in Python's whole numbers, and against SQL."""

import hashlib
import math

import duckdb
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallymill.llm import exponion

from .conftest import SF

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plainly(rows, k=8, rounds=10, length=64, scale=1024):
    most = min(1 << 27, int((2**61 / length) ** 0.5))
    kept = [(i, [math.floor(max(-most, min(most, float(np.float32(x)) * scale))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)
    centroids = [q for _, q in hashed[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            mine = [q for (_, q), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [(i, *nearest(q)[::-1]) for i, q in kept]
    of = {j: sum(d for _, o, d in found if o == j) for j in range(len(centroids))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, of[j], sum(of.values()), digest[j]) for i, j, d in found), key=str)


def compare(spark, rows, parts=3, **more):
    found = exponion.clusters(spark.createDataFrame(rows, SCHEMA).repartition(parts), **more).collect()
    assert sorted(map(tuple, found), key=str) == plainly(rows, **more)


def blobs(n, length, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, length))
    return [(i, [float(x) for x in (centres[i % 6] + spread * rng.standard_normal(length)).astype(np.float32)], i % 3) for i in range(n)]


def test_agrees_with_plain_means(spark, monkeypatch):
    monkeypatch.setattr(exponion, "BLOCK", 50)
    compare(spark, blobs(300, 64, 1))
    compare(spark, blobs(200, 5, 2, 1.0), k=13, length=5, rounds=6)


def test_ties_on_a_coarse_grid(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)], 1) for i in range(300)]
    compare(spark, rows, k=11, length=3, scale=1, rounds=7)  # many equal distances and equal centroids


def test_odd_rows(spark):
    ok = blobs(30, 64, 7)
    odd = [(None, ok[0][1], None), (None, ok[1][1], 1), (100, None, 1), (101, [], 1), (102, [1.0] * 63, 1), (103, [1.0] * 63 + [None], 1), (104, [float("nan")] * 64, 1), (105, [float("inf")] + [0.0] * 63, 1)]
    big = [(106, [3e38] * 64, 1), (107, [-3e38] * 64, 1), (3, ok[9][1], 2), (3, ok[3][1], 2), (3, ok[3][1], 2), (108, [0.0] * 64, 1), (109, [-1e-9] * 64, None)]
    compare(spark, ok + odd + big)
    compare(spark, odd + big[:2], rounds=2)  # fewer vectors than centroids
    compare(spark, [(i, [1.5] * 64, 1) for i in range(20)], rounds=2)  # all equal
    compare(spark, [(1, [1.5] * 64, 1)], k=1, rounds=1)
    empty = exponion.clusters(spark.createDataFrame(odd[2:], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    clash = spark.createDataFrame(ok, SCHEMA).withColumns({c: F.lit("x") for c in ("q", "cluster", "distance", "place", "n", "h", "sum", "all")})
    assert sorted(map(tuple, exponion.clusters(clash).collect()), key=str) == plainly(ok)


def test_the_ball_saves_distances(spark):
    found = exponion.fit(exponion.whole_vectors(spark.createDataFrame(blobs(600, 64, 3), SCHEMA)), k=24, rounds=8)
    assert found.compared[0] == 600 * 24
    assert found.compared[-1] < 600 * 24 / 4


def test_agrees_with_sql(spark):
    found = exponion.clusters(spark.read.parquet(f"{SF}/embeddings.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rows = db.sql(exponion.ORACLE_SQL)
    assert rows.columns == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(rows.fetchall())
