"""Operator 2: near-duplicate embeddings by hierarchical navigable small-world graphs.

Vectors are compared within one label and length. Those that are null, zero or hold null or non-finite components, and those without
label, link with nothing. Equal vectors are one class.

1. A label's classes are dealt by hash to shards of some ``SHARD`` vectors of 64 numbers (fewer if longer), and each shard gets a graph (``hnsw``).
   Graphs are written to files of the shared folder, one file a task; what is shuffled is where they lie.
2. Every shard is asked for the neighbours of every vector of its label: pairs of shards are searched both ways, by tasks that read one graph and
   up to ``ASKED`` others, one at a time. A repeated task writes a file of its own, and no one is told of an unfinished one.
   Each search is audited: for ``AUDIT`` of its vectors all links are worked out by exact products, and the beam is doubled until
   the search finds them all (as many as half a beam holds; the rest of a larger family is reached through those); where even a beam as wide as
   the shard doesn't, the shard is scanned. What is near is emitted as a spanning forest.
3. Components of these forests are families. Within a family all pairs are verified in double precision,
   block by block, and counted; edges that connect what is linked give the components of the result.

So counts are exact within families, and a link is missed only if its two vectors find no way to each other through any
near vector. No group meets in one task and no pair is emitted.

Cases: rows with one vec_id are vectors of their own. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrow_output import file_system
from .blocks import count_links
from .hnsw import Graph
from .shared import components, grouped, local_forest, materialise, runs, shared_dir, small_batches

COSINE = 0.98
SHARD = 65_536
BEAM = 48
AUDIT = 512
#: Other shards that a task asks with the graph that it has read.
ASKED = 8
PLACE = "struct<path: string, at: long, size: long>"
#: float32 products may fall short of the cosine by so much; pairs are verified later.
SLACK = 1e-4


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    v = flat.astype(np.float64).reshape(n, -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # lest squares overflow or vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _build(folder: str):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        path, sink, at = f"{base}/{uuid.uuid4().hex}.graphs", None, 0
        for t in runs(batches, ("space", "shard")):
            if sink is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(path)
            keys = t.column("key").to_numpy()
            data = pickle.dumps((keys, Graph(_unit(t.column("embedding").flatten().to_numpy(zero_copy_only=False), len(keys)))), protocol=5)
            sink.write(data)
            place = pa.array([{"path": path, "at": at, "size": len(data)}], pa.struct([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())]))
            yield pa.record_batch([t.column("space")[:1], t.column("shard")[:1], pa.array([len(keys)], pa.int64()), place], names=["space", "shard", "n", "place"])
            at += len(data)
        if sink is not None:
            sink.close()

    return build


def audited_search(graph: Graph, queries: np.ndarray, least: float, own: bool, beam: int = BEAM, audit: int = AUDIT) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, node) at ``least`` or more, and the beam that the audit let pass. own: queries are the graph's own nodes, in order."""
    n = len(graph.x)
    picked = np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(np.int64))
    true = []
    for a in range(0, len(picked), 64):
        near = queries[picked[a : a + 64]] @ graph.x.T >= least + 2 * SLACK
        if own:
            near[np.arange(len(near)), picked[a : a + 64]] = False
        true.append(near)
    true = np.concatenate(true)
    while True:
        beam = min(beam, n)
        ids, value = graph.search(queries[picked], beam)
        hit = np.zeros(true.shape, bool)
        r, c = np.nonzero((value >= least) & (ids >= 0))
        hit[r, ids[r, c]] = True
        want = np.minimum(true.sum(axis=1), max(1, beam // 2))
        if ((hit & true).sum(axis=1) >= want).all():
            break
        if beam >= n:  # parts of the graph can't be reached: the shard is scanned
            found = [(queries[a : a + 256] @ graph.x.T >= least).nonzero() for a in range(0, len(queries), 256)]
            return np.concatenate([r + 256 * k for k, (r, _) in enumerate(found)]), np.concatenate([c for _, c in found]), n
        beam *= 2
    ids, value = graph.search(queries, beam)
    r, c = np.nonzero((value >= least) & (ids >= 0))
    return r, ids[r, c], beam


def _find(cosine: float, folder: str):
    least = cosine - SLACK

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)

        def graph_at(place: dict) -> tuple[np.ndarray, Graph]:
            with files.open_input_file(place["path"]) as source:
                source.seek(place["at"])
                return pickle.loads(source.read(place["size"]))

        for batch in batches:
            for row in batch.to_pylist():
                keys, graph = graph_at(row["one"])
                for other in row["others"]:
                    if other == row["one"]:
                        a, b, _ = audited_search(graph, graph.x, least, True)
                        every = keys
                    else:
                        keys_b, graph_b = graph_at(other)
                        qa, ib, _ = audited_search(graph_b, graph.x, least, False)
                        qb, ia, _ = audited_search(graph, graph_b.x, least, False)
                        a, b = np.concatenate([qa, ia]), np.concatenate([ib, qb]) + len(keys)
                        every = np.concatenate([keys, keys_b])
                    root = local_forest(a, b, len(every))
                    own = np.flatnonzero(root != np.arange(len(every)))
                    yield pa.record_batch([pa.array(every[own]), pa.array(every[root[own]])], names=["src", "dst"])

    return find


def _searches(graphs: DataFrame, shard: int) -> DataFrame:
    """Which graph asks which others of its space, itself too, in as many tasks as there is work for."""
    one = graphs.select("space", F.col("shard").alias("one_shard"), F.col("place").alias("one"))
    other = graphs.select("space", F.col("shard").alias("other_shard"), F.col("place").alias("other"), "n")
    some = one.join(other, "space").where("one_shard <= other_shard").groupBy("space", "one_shard", F.floor(F.col("other_shard") / ASKED))
    asked = materialise(some.agg(F.first("one").alias("one"), F.collect_list("other").alias("others"), F.sum("n").alias("n")).select("one", "others", "n"), "searches")
    rows, n = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    return asked.repartition(max(1, min(rows, max(3 * asked.sparkSession.sparkContext.defaultParallelism, -(-n // shard)))))


def _near(cosine: float):
    def near(one: pa.Array, other: pa.Array | None) -> np.ndarray:
        a = _unit(one.flatten().to_numpy(zero_copy_only=False), len(one))
        if other is not None:
            return a @ _unit(other.flatten().to_numpy(zero_copy_only=False), len(other)).T >= cosine
        found = a @ a.T >= cosine
        return found | found.T

    return near


def near_vectors(vectors: DataFrame, cosine: float = COSINE, shard: int = SHARD) -> DataFrame:
    """Per vector: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable by links), kept (vec_id = component_id), copies_id (smallest vec_id of the equal vectors)."""
    spark = vectors.sparkSession
    small_batches(spark)
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0)
    space = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").withColumn("sound", F.coalesce(sound, F.lit(False)))
    rows = rows.withColumn("space", F.when(F.col("sound"), space)).withColumn("key", F.when(F.col("sound"), F.xxhash64("space", "embedding")))
    classes = rows.where("key is not null").groupBy("key", "space").agg(F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = materialise(classes, "vectors")
    shards = classes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.lit(1.0), F.max(F.size("embedding")) / 64) / shard).alias("shards"))
    dealt = classes.join(shards, "space").select("space", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard"), "key", "embedding")
    built = dealt.repartition("space", "shard").sortWithinPartitions("space", "shard", "key")
    folder = f"{shared_dir(spark)}/graphs-{uuid.uuid4().hex}"
    graphs = materialise(built.mapInArrow(_build(folder), f"space string, shard int, n long, place {PLACE}"), "places")
    found = materialise(_searches(graphs, shard).mapInArrow(_find(cosine, folder), "src long, dst long"), "found")
    families = components(found)
    sizes = families.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    members = families.join(sizes, "component").withColumnRenamed("node", "key").join(classes.select("key", "copies", F.col("embedding").cast("array<double>").alias("payload")), "key")
    blocks = F.ceil(F.greatest(F.col("size") / shared.BLOCK, F.col("size") * F.size("payload") * 8 / shared.BLOCK_BYTES))
    members = members.withColumn("blocks", blocks).withColumns({"wide": F.col("blocks") > 1, "bin": F.lit(0)})
    counts, edges = count_links(members, _near(cosine))
    linked = counts.join(components(edges).withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("component", "key").alias("component"))
    return grouped(rows.select("vec_id", "key"), linked, "vec_id").select("vec_id", "n_links", "component_id", "kept", "copies_id")
