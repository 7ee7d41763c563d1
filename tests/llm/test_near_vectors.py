"""Operator 2 against all pairs in double precision."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallymill.llm import near_vectors, shared
from tallymill.llm.hnsw import Graph

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def clusters(n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            base = np.array(rows[int(rng.integers(len(rows)))][1])
            v, label = base + rng.standard_normal(dim) * rng.choice([0, 0.02, 0.04, 0.06]) * np.linalg.norm(base) / 4, rows[-1][2]
        else:
            v, label = rng.standard_normal(dim) * rng.choice([0.1, 1, 10]), int(rng.integers(0, 3))
        rows.append((i, [float(x) for x in v.astype(np.float32)], label))
    return rows


def all_pairs(rows):
    ok = [i for i, (_, v, label) in enumerate(rows) if v and label is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    unit = {i: np.array(rows[i][1], np.float64) / np.linalg.norm(np.array(rows[i][1], np.float64)) for i in ok}
    for x, a in enumerate(ok):
        for b in ok[:x]:
            if rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return {r[0]: (links[k], least[find(k)], least[find(k)] == r[0]) for k, r in enumerate(rows)}


def compare(spark, rows, **more):
    found = near_vectors.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), **more).collect()
    assert len(found) == len(rows)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == all_pairs(rows)


def test_one_shard(spark):
    compare(spark, clusters())


def test_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(shared, "BLOCK", 9)
    compare(spark, clusters(seed=5), shard=40)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v, 1), (1, v, 1), (2, v, 2), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0] * 3, 1), (7, [1.0, None, 3.0], 1), (8, [float("nan"), 2.0, 3.0], 1), (9, [float("inf"), 2.0, 3.0], 1)]
    rows += [(10, [2.0, 4.0, 6.0], 1), (11, [1.0, 2.0], 1), (12, [1e30, 2e30, 3e30], 1), (13, [1e-40, 2e-40, 3e-40], 2), (14, [-1.0, -2.0, -3.0], 1)]
    compare(spark, rows)
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(None, v, 1), (None, v, 1)], SCHEMA)
    assert [r["n_links"] for r in near_vectors.near_vectors(one).collect()] == [1, 1]


def test_graphs_find_neighbours():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32)).astype(np.float32)
    x[1500:] = x[:1500] + rng.standard_normal((1500, 32)).astype(np.float32) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x)
    ids, _ = graph.search(x, 48)
    near = x @ x.T
    np.fill_diagonal(near, -1)
    assert np.mean([near[i].argmax() in ids[i] for i in range(3000)]) > 0.999
    exact = np.argsort(-(x @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(ids[i, :10]) & set(exact[i])) / 10 for i in range(3000)]) > 0.9


def test_audits_widen_beams():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph(x, links=2, beam=2)
    a, b, beam = near_vectors.audited_search(graph, x, 0.9, True, beam=2)
    assert beam > 2
    found = np.zeros((600, 600), bool)
    found[a, b] = True
    true = x @ x.T >= 0.9 + 2 * near_vectors.SLACK
    np.fill_diagonal(true, False)
    assert ((found & true).sum(axis=1) >= np.minimum(true.sum(axis=1), beam // 2)).mean() > 0.99


def test_clashing_columns(spark):
    rows = clusters(n=60, seed=8)
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "space", "shard", "copies", "component", "links", "n_links", "kept", "block", "blocks", "payload", "place")})
    found = near_vectors.near_vectors(clash).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == all_pairs(rows)
