"""Groups too large for one task, compared block by block.

A block is written once to a file of the shared folder, as an Arrow stream; what is shuffled afterwards is where it lies. A task that compares
blocks reads its own and the others one at a time. A repeated task writes a file of its own, and no one is told of an unfinished one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_output import file_system
from .shared import Forest, local_forest, materialise, runs, shared_dir, touching

#: Other blocks that a row of work names at most.
ASKED = 32
#: Rows of work that a task gets, where there are more than tasks.
WORK = 16
PLACE = "struct<block: long, path: string, at: long, size: long>"
PLACED = pa.struct([("block", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
#: A block's number holds its bin in the upper half and its place in the bin in the lower.
LOWER = (1 << 32) - 1


def new_folder(df: DataFrame, name: str) -> str:
    return f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def numbered(bin_: Column, blocks: Column) -> Column:
    """The number of the block that a row's key is dealt to by hash, of its bin's ``blocks``."""
    return F.shiftleft(bin_.cast("long"), 32) + F.pmod(F.xxhash64("key", F.lit(1)), blocks)


class BlockFile:
    """The blocks that one task writes, end to end in a file that is opened for the first of them."""

    def __init__(self, folder: str):
        self.files, self.base = file_system(folder)
        self.path, self.sink, self.at = f"{self.base}/{uuid.uuid4().hex}.blocks", None, 0

    def add(self, block: int, rows: pa.RecordBatch) -> dict:
        if self.sink is None:
            self.files.create_dir(self.base, recursive=True)
            self.sink = self.files.open_output_stream(self.path)
        stream = pa.BufferOutputStream()
        with pa.ipc.new_stream(stream, rows.schema) as writer:
            writer.write_batch(rows)
        data = stream.getvalue()
        self.sink.write(data)
        place = {"block": block, "path": self.path, "at": self.at, "size": data.size}
        self.at += data.size
        return place

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()


def read_block(files, place: dict) -> pa.RecordBatch:
    with files.open_input_file(place["path"]) as source:
        source.seek(place["at"])
        return pa.ipc.open_stream(source.read_buffer(place["size"])).read_next_batch()


def meetings(pairs: DataFrame, *by: Column | str) -> DataFrame:
    """Pairs (one, other) of places as rows of work (one, others), ``ASKED`` others at most, in as many tasks as there is work for.

    ``by`` tells the blocks that are ``one``; pairs' others are gathered by their numbers.
    """
    bin_, part = F.shiftright("other.block", 32), F.floor(F.col("other.block").bitwiseAND(F.lit(LOWER)) / ASKED)
    work = pairs.groupBy(*by, bin_, part).agg(F.first("one").alias("one"), F.collect_list("other").alias("others"))
    work = materialise(work.select("one", "others"), "meetings")
    n = work.count()
    # the number is given, lest so few bytes be taken for little work
    return work.repartition(max(1, min(n, max(3 * work.sparkSession.sparkContext.defaultParallelism, n // WORK))))


def _inside(near: Callable, folder: str):
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows = BlockFile(folder), []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), *(pa.list_(pa.int64()),) * 3, PLACED)
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["component", "keys", "links", "roots", "place"])
            rows.clear()
            return batch

        for t in runs(batches, ("component", "block")):
            key, copies = t.column("key").to_numpy(), t.column("copies").to_numpy()
            found = near(t.column("payload"), None)
            np.fill_diagonal(found, False)
            root = key[local_forest(*np.nonzero(found), len(key))]
            place = None
            if t.column("wide")[0].as_py():
                place = file.add(t.column("block")[0].as_py(), pa.record_batch([t.column("key"), t.column("copies"), pa.array(root), t.column("payload")], names=["key", "copies", "root", "payload"]))
            rows.append((t.column("component")[0].as_py(), key, (found * copies).sum(axis=1), root, place))
            if len(rows) == 256:
                yield out()
        file.close()
        if rows:
            yield out()

    return inside


def _between(near: Callable, folder: str):
    """Of rows of work: the links of block ``one`` to the others, and edges between roots."""

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)
        kind = pa.list_(pa.int64())
        for batch in batches:
            for row in batch.to_pylist():
                one, forest, edges = read_block(files, row["one"]), Forest(), []
                links, roots = np.zeros(one.num_rows, np.int64), one.column("root").to_numpy()
                for place in row["others"]:
                    other, first = read_block(files, place), row["one"]["block"] < place["block"]
                    a, b = one.column("payload"), other.column("payload")
                    # one order of operands for both ways, so that both round alike
                    found = near(a, b) if first else near(b, a).T
                    links += (found * other.column("copies").to_numpy()).sum(axis=1)
                    if first:
                        edges += [e for e in touching(found, roots, other.column("root").to_numpy()) if forest.join(*e)]
                src, dst = zip(*edges, strict=True) if edges else ((), ())
                yield pa.record_batch([pa.array([x], kind) for x in (one.column("key").to_numpy(), links, src, dst)], names=["keys", "links", "src", "dst"])

    return between


def count_links(members: DataFrame, near: Callable) -> tuple[DataFrame, DataFrame]:
    """All pairs of a component's classes are compared: (key, links: rows of other classes linked), and edges (src, dst) that connect what is linked.

    members: component, wide (whether the component has more than one block), bin and blocks (of that bin), key, copies, payload. Classes whose
    bins are more than 1 apart must not be near; they aren't compared. ``near(one, other)`` gives a matrix of truth for two
    arrays of payloads, or within one if other is None.

    Payloads are shuffled once, to blocks dealt by hash. Each block is compared in itself, which gives a
    star for each connected set in it; a wide component's block is written to a file. Then each is held against the others of its bin and the
    two next to it, whose places alone were shuffled: pairs are only counted, and edges lead between the blocks' roots. So
    bytes shuffled grow with the classes, but for some 100 for each two blocks; reads and arithmetic are quadratic within neighbouring bins.
    """
    dealt = members.select("component", numbered(F.col("bin"), F.col("blocks")).alias("block"), "wide", "key", "copies", "payload")
    dealt = dealt.repartition("component", "block").sortWithinPartitions("component", "block", "key")
    folder = new_folder(members, "blocks")
    lists = ", ".join(f"{c} array<long>" for c in ("keys", "links", "roots"))
    inside = materialise(dealt.mapInArrow(_inside(near, folder), f"component long, {lists}, place {PLACE}"), "inside")
    counts = inside.select(F.explode(F.arrays_zip("keys", "links", "roots")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.links").alias("links"), F.col("x.roots").alias("root"))
    edges = counts.select(F.col("key").alias("src"), F.col("root").alias("dst")).where("src <> dst")
    counts = counts.select("key", "links")
    wide = inside.where("place is not null").select("component", "place")
    if not wide.isEmpty():
        bin_ = F.shiftright("place.block", 32)
        one = wide.select("component", bin_.alias("bin"), F.col("place").alias("one"))
        other = wide.select("component", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"), F.col("place").alias("other"))
        pairs = one.join(other, ["component", "bin"]).where("one.block <> other.block")
        work = meetings(pairs, "component", F.col("one.block"))
        between = materialise(work.mapInArrow(_between(near, folder), "keys array<long>, links array<long>, src array<long>, dst array<long>"), "between")
        more = between.select(F.explode(F.arrays_zip("keys", "links")).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.links").alias("links"))
        counts = counts.union(more).groupBy("key").agg(F.sum("links").alias("links"))
        edges = edges.union(between.select(F.explode(F.arrays_zip("src", "dst")).alias("x")).select("x.src", "x.dst"))
    return counts, edges
