"""Operator 12: k-means over whole numbers, searched by Exponion.

Components become whole numbers, floor(scale * x), so that distances, sums and means are exact and every run and partitioning gives the same clusters.

1. Vectors are written once, in blocks, to files of the shared folder; a block is a row with its place. Between rounds a block's row carries, for each vector, its
   cluster, an upper bound of the distance to its centroid and a lower bound of the distance to any other one.
2. A round moves the bounds by as much as the centroids moved. A vector whose upper bound stays below its lower bound, or below half the way from its centroid to
   the nearest other one, can't change. For the others the distance to their own centroid is worked out; where that doesn't settle it, they scan the centroids inside a ball
   around their own, of radius 2 x distance + the way to the nearest other centroid, along the list of the centroids sorted by their distances from it. The ball is inclusive and bounds have
   some slack, so ties are always compared, by whole numbers.
3. Each task adds up its vectors by cluster and gives one row; Spark adds those. Only centroids, ``k`` x ``length`` numbers, go through the driver, which is
   the size that is broadcast with the next round's tasks.

Vectors are kept if they have exactly ``length`` components, none of them null or non-finite; all others give no row. Whole numbers beyond +-``MOST`` become +-``MOST``,
so that a squared distance is a long. Of ties the smaller centroid wins; vectors with equal hashes (equal ids) start in the order of their components. Fewer vectors than ``k`` make as many
centroids as there are vectors. A cluster that loses all vectors keeps its centroid. Rows with one vec_id are vectors of their own, a null vec_id is hashed as "". Inertias beyond a long are the
largest long. An empty table gives no rows. Extra columns are left out.

Lost executors: a round reads the table that the round before wrote, and files that are never written again; a repeated task of the first step writes a file of its own.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_output import file_system
from .shared import batches_of, broadcast_if_small, materialise, shared_dir

K, ROUNDS, SCALE, LENGTH = 8, 10, 1024, 64
#: Whole numbers lie within these bounds: (2 * 2^27)^2 * 64 is below 2^63. Longer vectors get narrower ones.
MOST = 1 << 27
#: Vectors of a block; a task holds one.
BLOCK = 4096
#: Bounds are widened by so much, relatively, which is far more than what roots and sums are rounded by.
SLACK = 1e-12
PLACE = pa.struct([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
#: A block's row, or (place is null) what a task has added up.
STATE = pa.schema([("place", PLACE), ("n", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("compared", pa.int64())])
STATE_SQL = "place struct<path: string, at: long, size: long>, n long, cluster binary, upper binary, lower binary, sums array<long>, counts array<long>, compared long"


@dataclass
class Centroids:
    """Centroids with their ways between each other, and how far each has come since the round before."""

    at: np.ndarray
    moved: np.ndarray
    between: np.ndarray = field(init=False)
    nearest: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)

    def __post_init__(self):
        k = len(self.at)
        squared = np.stack([((self.at - c) ** 2).sum(axis=1) for c in self.at])
        ways = np.sqrt(squared.astype(np.float64))
        np.fill_diagonal(ways, np.inf)  # a centroid isn't its own neighbour, and stands last in its list
        self.order = np.argsort(ways, axis=1, kind="stable")[:, : k - 1]
        self.between = np.take_along_axis(ways, self.order, axis=1)
        self.nearest = self.between[:, 0] if k > 1 else np.full(k, np.inf)


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = q - c
    return np.einsum("ij,ij->i", d, d)


def scan_all(q: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """cluster, upper, lower and how many distances were worked out, from all centroids."""
    ways = np.stack([squared(q, c) for c in centroids.at], axis=1)
    cluster = ways.argmin(axis=1)
    upper = np.sqrt(ways[np.arange(len(q)), cluster].astype(np.float64))
    lower = np.sqrt(np.partition(ways, 1, axis=1)[:, 1].astype(np.float64)) if ways.shape[1] > 1 else np.full(len(q), np.inf)
    return cluster, upper, lower, ways.size


def search(q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same as ``scan_all`` gives for clusters, from the bounds of the round before."""
    k, moved = len(centroids.at), centroids.moved
    cluster = cluster.copy()
    farthest = int(moved.argmax())
    others = np.where(np.arange(k) == farthest, np.delete(moved, farthest).max(initial=0.0), moved[farthest])
    upper = (upper + moved[cluster]) * (1 + SLACK)
    lower = (lower - others[cluster]) * (1 - SLACK) - SLACK
    half = centroids.nearest / 2 * (1 - SLACK)
    at = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    exact = squared(q[at], centroids.at[cluster[at]])
    compared = len(at)
    upper[at] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
    still = upper[at] >= np.maximum(lower[at], half[cluster[at]])
    at, exact = at[still], exact[still]
    radius = (2 * upper[at] + centroids.nearest[cluster[at]]) * (1 + SLACK) + SLACK
    old = cluster[at]
    for c in np.unique(old):
        mine = np.flatnonzero(old == c)
        mine = mine[np.argsort(-radius[mine], kind="stable")]
        reach = -radius[mine]
        rows = at[mine]
        best, who = exact[mine].copy(), np.full(len(mine), c)
        second = np.full(len(mine), np.iinfo(np.int64).max)
        for j, way in zip(centroids.order[c], centroids.between[c], strict=True):
            m = int(np.searchsorted(reach, -way, side="right"))  # balls that reach so far, their edge included
            if not m:
                break
            found = squared(q[rows[:m]], centroids.at[j])
            compared += m
            closer = (found < best[:m]) | ((found == best[:m]) & (j < who[:m]))
            second[:m] = np.where(closer, best[:m], np.minimum(second[:m], found))
            best[:m] = np.where(closer, found, best[:m])
            who[:m] = np.where(closer, j, who[:m])
        cluster[rows] = who
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[rows] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(np.float64)) * (1 - SLACK))
    return cluster, upper, lower, compared


def _write(folder: str, length: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        path, sink, at = f"{base}/{uuid.uuid4().hex}.vectors", None, 0
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                if sink is None:
                    files.create_dir(base, recursive=True)
                    sink = files.open_output_stream(path)
                q = part.column("q").flatten().to_numpy().astype(np.int32).reshape(-1, length)
                ids = part.column("vec_id")
                data = pickle.dumps((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), q), protocol=5)
                sink.write(data)
                yield _row({"path": path, "at": at, "size": len(data)}, part.num_rows)
                at += len(data)
        if sink is not None:
            sink.close()

    return write


def _row(place, n, cluster=None, upper=None, lower=None, sums=None, counts=None, compared=0) -> pa.RecordBatch:
    values = (place, n, *(None if x is None else x.tobytes() for x in (cluster, upper, lower)), sums, counts, compared)
    return pa.record_batch([pa.array([v], f.type) for v, f in zip(values, STATE, strict=True)], schema=STATE)


def _block(files, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with files.open_input_file(place["path"]) as source:
        source.seek(place["at"])
        ids, valid, q = pickle.loads(source.read(place["size"]))
    return ids, valid, q.astype(np.int64)


def _assigned(row: dict, q: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    if row["cluster"] is None:
        return scan_all(q, centroids)
    return search(q, np.frombuffer(row["cluster"], np.int32).astype(np.int64), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]), centroids)


def _step(folder: str, centroids: Centroids):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)
        k, length = centroids.at.shape
        sums, counts, compared = np.zeros((k, length), np.int64), np.zeros(k, np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                _, _, q = _block(files, row["place"])
                cluster, upper, lower, n = _assigned(row, q, centroids)
                order = np.argsort(cluster, kind="stable")
                present, first = np.unique(cluster[order], return_index=True)
                sums[present] += np.add.reduceat(q[order], first)
                counts += np.bincount(cluster, minlength=k)
                compared += n
                yield _row(row["place"], len(q), cluster.astype(np.int32), upper, lower)
        yield _row(None, 0, sums=sums.ravel(), counts=counts, compared=compared)

    return step


def _last(folder: str, centroids: Centroids):
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, valid, q = _block(files, row["place"])
                cluster = _assigned(row, q, centroids)[0]
                yield pa.record_batch([pa.array(ids, mask=~valid), pa.array(cluster.astype(np.int32)), pa.array(squared(q, centroids.at[cluster]))], names=["vec_id", "cluster", "distance"])

    return last


def whole_vectors(vectors: DataFrame, length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the whole numbers of the vectors that are kept."""
    most = min(MOST, int((2**61 / length) ** 0.5))
    sound = (F.size("embedding") == length) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bounded = lambda x: F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x.cast("double") * scale))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(bounded(x)).cast("int")).alias("q"))


@dataclass
class Clusters:
    """What ``fit`` gives: rows (vec_id, cluster, distance), the final centroids, and by round how many distances were worked out."""

    rows: DataFrame
    centroids: np.ndarray
    compared: list[int]


def fit(kept: DataFrame, k: int = K, rounds: int = ROUNDS, seed: str = "3:") -> Clusters:
    """Cluster rows (vec_id, q), all q of one length: ``rounds`` rounds of means, then a last assignment."""
    spark = kept.sparkSession
    hashed = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    starts = [r["q"] for r in kept.select(hashed.alias("h"), "q").orderBy("h", "q").limit(k).collect()]
    if not starts:
        return Clusters(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, 0), np.int64), [])
    at = np.array(starts, np.int64)
    length = at.shape[1]
    folder = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    with batches_of(spark, BLOCK):
        state = materialise(kept.select("vec_id", "q").mapInArrow(_write(folder, length), STATE_SQL), "blocks")
    centroids, compared = Centroids(at, np.zeros(len(at))), []
    tasks = max(1, min(state.count(), 4 * spark.sparkContext.defaultParallelism, 100_000))
    dealt = lambda: state.where("place is not null").repartition(tasks)
    with batches_of(spark, 8):  # a row holds a block's bounds
        for _ in range(rounds):
            state = materialise(dealt().mapInArrow(_step(folder, centroids), STATE_SQL), "round")
            added = state.where("place is null")
            total = added.select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
            counts = added.select(F.posexplode("counts")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).collect()
            sums = np.zeros(at.size, object)
            for r in total:
                sums[r["pos"]] = int(r["total"])
            count = {r["pos"]: int(r["total"]) for r in counts}
            sums = sums.reshape(at.shape)
            new = np.array([[x // count[j] for x in sums[j]] if count[j] else at[j].tolist() for j in range(len(at))], np.int64)
            compared.append(int(added.agg(F.sum("compared")).first()[0]))
            centroids = Centroids(new, np.sqrt(((new - at) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK))
            at = new
        rows = materialise(dealt().mapInArrow(_last(folder, centroids), "vec_id long, cluster int, distance long"), "clusters")
    return Clusters(rows, at, compared)


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, scale: int = SCALE, seed: str = "3:") -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    found = fit(materialise(whole_vectors(vectors, length, scale), "whole"), k, rounds, seed)
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(found.centroids)]
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_cluster = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"))
    whole = by_cluster.agg(F.sum("sum").cast("decimal(38,0)").alias("all"))  # at most k rows
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    totals = by_cluster.crossJoin(F.broadcast(whole)).join(named, "cluster")
    totals = materialise(totals.select("cluster", F.least("sum", most).cast("long").alias("cluster_inertia"), F.least("all", most).cast("long").alias("inertia"), "centroid_sha256"), "totals")
    return found.rows.join(broadcast_if_small(totals), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int) -> str:
    way = "list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings\n"
        "  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT j, q FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), q) - 1 AS j, q FROM kept) WHERE j < 8)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT v.r, min({{'d': {way}, 'j': c.j}}) AS m FROM kept v CROSS JOIN c{i} c GROUP BY v.r)")
        if i < rounds:
            parts.append(
                f"s{i} AS MATERIALIZED (SELECT a.m.j AS j, u.i AS i, sum(v.q[u.i]) AS s, count(*) AS n FROM a{i} a JOIN kept v USING (r) CROSS JOIN range(1, 65) u(i) GROUP BY ALL)"
            )
            parts.append(f"m{i} AS MATERIALIZED (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS q FROM s{i} GROUP BY j)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{i} c LEFT JOIN m{i} m USING (j))")
    return "WITH " + ",\n".join(parts) + (
        f"\nSELECT v.vec_id, CAST(a.m.j AS INTEGER) AS cluster, CAST(a.m.d AS BIGINT) AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.j) AS BIGINT) AS cluster_inertia,\n"
        f"  CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256\nFROM a{rounds} a JOIN kept v USING (r) JOIN c{rounds} c ON c.j = a.m.j"
    )


ORACLE_SQL = _oracle(ROUNDS)
