"""Helpers that the operators of this subpackage share: tables, the shared folder, hashing of words and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that Python workers get; with whole texts this keeps a batch to some MB.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Without one nothing may be written, so an error is raised."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")  # one machine is all there is
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing that is done."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each_in_a_task(manifest: DataFrame) -> DataFrame:
    """A written table of files, some file a task: the number is given, lest so few bytes be taken for little work."""
    return manifest.repartition(max(1, manifest.count()))


#: Rows of ids and a few numbers, some 8 MB, that may be broadcast; beyond that a join shuffles.
BROADCAST_ROWS = 200_000


def broadcast_if_small(written: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of ids that was written before, marked for broadcast if a count shows that it has no more than ``rows`` rows."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches hold at most ``rows`` rows, so that long texts don't fill a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 is 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end (null: none), and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


#: Bytes whose words are hashed at once.
STRETCH = 1 << 20


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each row, and the n + 1 offsets of the rows' words.

    A word is a run of bytes other than space and \\x09-\\x0D. No word joins two rows. A word's value is the sum of
    (byte + 1) * base^place over it, worked out by stretches of ``STRETCH`` bytes; a word that goes on into the next stretch has its shares added.
    """
    n = len(data)
    rows = len(offsets) - 1
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    is_first = np.zeros(n + 1, bool)
    is_first[offsets[:-1]] = True
    values, lengths, places = [], [], []
    going: tuple[int, int] | None = None  # where the word that reached the stretch's end began, and its value so far
    for at in range(0, n, STRETCH):
        part = data[at : at + STRETCH]
        inside = (part != 32) & ((part < 9) | (part > 13))
        new = is_first[at : at + len(part)]
        before = np.concatenate([[going is not None], inside[:-1]])
        starts = inside & (~before | new)
        s = np.flatnonzero(starts)
        stops = before & (~inside | new)  # a word ended before this byte
        e = np.flatnonzero(stops)
        if inside[-1]:
            e = np.append(e, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(part)), out=total[1:])
        if going is not None:
            s = np.concatenate([[0], s])
        value = (total[e] - total[s]) * _power_table(_INVERSE, len(part))[s]
        length, place = e - s, s + at
        if going is not None:
            place[0] = going[0]
            length[0] += at - going[0]
            value[0] = (going[1] + int(value[0]) * pow(_BASE, at - going[0], 2**64)) % 2**64
        going = None
        if inside[-1] and at + len(part) < n:
            going = (int(place[-1]), int(value[-1]))
            value, length, place = value[:-1], length[:-1], place[:-1]
        values.append(value)
        lengths.append(length)
        places.append(place)
    value, length, place = np.concatenate(values), np.concatenate(lengths), np.concatenate(places)
    return mix64(value ^ mix64(length.astype(np.uint64))), np.searchsorted(place, offsets)


#: Bytes of text that numpy works on at once; a single text may be longer.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and ``most_bytes`` bytes in ``column`` (or one row), none of them empty, to bound what numpy makes of one."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, before = 0, 0
        while at < batch.num_rows:
            stop = min(batch.num_rows, at + rows, max(at + 1, int(np.searchsorted(upto, before + most_bytes, side="right"))))
            yield batch.slice(at, stop - at)
            at, before = stop, int(upto[stop - 1])


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for what is run inside, for rows that hold much each."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name, "10000")
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, was)


def runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``columns``, from batches sorted by them; only one such run is held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        codes = [batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False) for c in columns]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in codes], axis=0)) + 1
        bounds = [0, *change.tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in columns):
            yield pa.concat_batches(held)
            held = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


#: Classes in a block of a group, and bytes of what they are compared by.
BLOCK, BLOCK_BYTES = 512, 8 << 20


class Forest:
    """Connected sets of any keys; ``join`` tells whether two were apart."""

    def __init__(self):
        self.up: dict = {}

    def root(self, key):
        up = self.up
        top = key
        while (above := up.get(top, top)) != top:
            top = above
        while key != top:
            up[key], key = top, up.get(key, key)
        return top

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def touching(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple]:
    """The distinct pairs (left[i], right[j]) with near[i, j]."""
    lefts, i = np.unique(left, return_inverse=True)
    rights, j = np.unique(right, return_inverse=True)
    met = np.zeros((len(lefts), len(rights)), bool)
    r, c = np.nonzero(near)
    met[i[r], j[c]] = True
    r, c = np.nonzero(met)
    return list(zip(lefts[r].tolist(), rights[c].tolist(), strict=True))


def grouped(rows: DataFrame, linked: DataFrame, id_column: str) -> DataFrame:
    """Rows (id, key) with their groups: copies_id, n_links, component_id, kept are added and ``key`` is left.

    ``linked`` has for keys with links: key, links (rows of other keys linked), component (a key). Rows of one key are
    linked with each other. Rows without a key are alone. Ids of copies and components are the smallest of their rows.
    """
    ids = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(id_column).alias("copies_id"))
    ids = ids.join(linked, "key", "left").select("key", "copies", "copies_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    ids = materialise(ids, "ids")
    ids = ids.join(ids.groupBy("component").agg(F.min("copies_id").alias("component_id")), "component")
    found = rows.join(ids.drop("component"), "key", "left")
    alone = F.col("key").isNull()
    component = F.when(alone, F.col(id_column)).otherwise(F.col("component_id"))
    return found.select(
        *rows.columns,
        F.when(alone, F.col(id_column)).otherwise(F.col("copies_id")).alias("copies_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col(id_column).eqNullSafe(component).alias("kept"),
    )


def crc(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values)) & 0xFFFFFFFF


def local_forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each component of the graph with nodes 0 .. n-1 and edges (a, b)."""
    root = np.arange(n)
    if len(a) == 0:
        return root
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _forest(t: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of edges (src, dst): names of the nodes, and by rank a node's place among the names and the rank of its root."""
    both = pa.concat_arrays([t.column("src"), t.column("dst")]).dictionary_encode()
    code, names = both.indices.to_numpy(), both.dictionary
    order = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    k = rank[code]
    return names, order, local_forest(k[: t.num_rows], k[t.num_rows :], len(order))


#: Edges that a task contracts together.
CONTRACTED = 1 << 18


def _contract(batches):
    """Replace each ``CONTRACTED`` edges of a partition by a star for each of their components: no more rows than distinct nodes."""

    def star(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_batches(held)
        t = t.filter(pc.invert(pc.equal(t.column("src"), t.column("dst"))))
        if t.num_rows:
            names, order, root = _forest(t)
            node = np.flatnonzero(root != np.arange(len(root)))
            yield pa.record_batch([names.take(pa.array(order[node])), names.take(pa.array(order[root[node]]))], names=["src", "dst"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CONTRACTED:
            yield from star(held)
            held, rows = [], 0
    if rows:
        yield from star(held)


def _settle(batches):
    """The nodes of all of a partition's edges with the roots of their components."""
    held = [b for b in batches if b.num_rows]
    if held:
        names, order, root = _forest(pa.concat_batches(held))
        yield pa.record_batch([names.take(pa.array(order)), names.take(pa.array(order[root]))], names=["node", "component"])


def components(edges: DataFrame, one_task: int = BROADCAST_ROWS) -> DataFrame:
    """Connected components of ``edges`` (src, dst, of one orderable type): (node, component), component being the least node reachable.

    Nodes without edges don't appear. Each task first contracts its edges to stars, ``CONTRACTED`` at a time. While more than ``one_task`` edges
    are left, a round hooks each node to the least of itself and its neighbours, jumps along the hooks until all point to
    roots, and goes on with the edges between roots; fewer edges are settled in one task. A root that takes no other
    node in a round has neighbours that went to lesser roots, so the next round hooks it: two rounds at least halve the
    nodes with edges, and a round jumps as often as the logarithm of its deepest tree. Rounds have no limit.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    levels = []
    while True:
        edges = materialise(edges.mapInArrow(_contract, f"src {kind}, dst {kind}").distinct(), "edges")
        if edges.limit(one_task + 1).count() <= one_task:
            labels = materialise(edges.coalesce(1).mapInArrow(_settle, f"node {kind}, component {kind}"), "labels")
            break
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.min(F.least("src", "dst")).alias("component")), "labels")
        while True:
            up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
            found = materialise(labels.join(up, "component").select("node", F.col("component").alias("old"), F.col("up").alias("component")), "labels")
            labels = found.select("node", "component")
            if found.where("component <> old").isEmpty():
                break
        levels.append(labels)
        src, dst = (labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_root")) for c in ("src", "dst"))
        edges = edges.join(src, "src").join(dst, "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst")).where("src <> dst")
    for level in reversed(levels):
        further = labels.select(F.col("node").alias("component"), F.col("component").alias("last"))
        labels = materialise(level.join(further, "component", "left").select("node", F.coalesce("last", "component").alias("component")), "labels")
    return labels
