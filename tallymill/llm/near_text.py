"""Operator 5: n-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Words are lower-case runs of characters other than space and \\x09-\\x0D; a text's n-grams are its runs of ``N`` words, or all its
words if it has fewer. Documents with equal n-gram sets are copies and form one class. Two documents are linked
if the Jaccard similarity of their sets is ``SIMILARITY`` or more.

1. One pass over whole texts gives each document's 64-bit hash of its n-gram set, ``bands`` hashes of
   ``rows`` minima each, and one byte of every minimum. ``choose_bands`` picks the numbers for the target recall.
2. Classes are shuffled on their band hashes. Within a bucket, classes whose bytes agree at fewer places than
   ``loose_agreement`` allows (eight standard deviations below the threshold) are told apart: ``families_of`` connects all others.
3. Only the families' texts are read again. Within a family all pairs are verified on their full n-gram sets, and counted.

No group meets in one task: large buckets and families are cut into blocks of some ``shared.BLOCK`` classes and ``shared.BLOCK_BYTES``,
written once to the shared folder and read by path (``blocks``), so bytes shuffled are linear in the classes but for the places of each two blocks.
Pairs are counted where two blocks meet and never emitted. Sets whose sizes alone keep them from being similar are not held against each other in a large
family; else the comparing and reading is quadratic in a family's distinct classes, since every link counts. No link is dropped. N-grams are compared by 64-bit hashes.

Cases: documents without a word (null, empty or blank) link with nothing. Rows with one doc_id are documents of their own; a group's id
is its smallest doc_id. An empty table gives no rows. Extra columns are left out by ``link`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrow_output import file_system
from .blocks import PLACE, PLACED, BlockFile, count_links, meetings, new_folder, numbered, read_block
from .shared import Forest, broadcast_if_small, components, grouped, materialise, mix64, runs, slices, small_batches, text_bytes, touching, word_hashes

N = 5
SIMILARITY = 0.8
RECALL = 0.9999
MOST_HASHES = 128
SEED = 20_240_501
#: What goes with a class to its block, beside its n-grams.
DEALT = ("component", "wide", "bin", "blocks", "key", "copies")


def choose_bands(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, with which pairs at ``similarity`` are still found with chance ``recall``."""
    best = None
    for rows in range(1, most_hashes + 1):
        meet = similarity**rows
        bands = 1 if meet >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-meet))
        if bands * rows <= most_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no bands reach the recall within so many hashes")
    return best


def shingles(text: pa.Array, n: int = N, step: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's n-grams (with repeats), and the offsets of each text's; ``step`` n-grams at a time."""
    data, offsets = text_bytes(pc.utf8_lower(text))
    words, bounds = word_hashes(data, offsets)
    count = np.diff(bounds)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    ends = np.concatenate([[0], np.cumsum(grams)])
    out = np.zeros(ends[-1], np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    salts = np.array([0x9E3779B97F4A7C15 * (k + 1) % 2**64 for k in range(n)], np.uint64)
    for at in range(0, len(out), step):
        place = np.arange(at, min(at + step, len(out)))
        of = np.searchsorted(ends, place, side="right") - 1
        first, length = bounds[of] + place - ends[of], np.minimum(count[of], n)
        own = out[at : at + step]
        for k in range(n):
            own[:] = mix64(own + salts[k] + np.where(k < length, padded[first + k], np.uint64(0)))
    return out, ends


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def sign(text: pa.Array, bands: int, rows: int, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Set hash, number of distinct n-grams, band hashes (texts, bands) and minima's bytes (texts, bands * rows)."""
    grams, ends = shingles(text, n)
    texts = len(ends) - 1
    key, size = np.zeros(texts, np.uint64), np.zeros(texts, np.int64)
    for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
        if b > a:
            own = np.unique(grams[a:b])
            size[i] = len(own)
            key[i] = (int(own.sum()) + 3 * int(mix64(own).sum())) % 2**64
    key = mix64(key ^ mix64(size.astype(np.uint64)))
    some = np.flatnonzero(size > 0)
    minima = np.zeros((bands * rows, texts), np.uint32)
    if len(some):
        low = (grams >> np.uint64(32)).astype(np.uint32)
        low ^= grams.astype(np.uint32)
        starts = ends[:-1][some]
        a, b = _multipliers(bands * rows)
        for k in range(bands * rows):
            v = low * a[k]
            v ^= v >> np.uint32(15)
            v *= b[k] | np.uint32(1)
            minima[k, some] = np.minimum.reduceat(v, starts)
    band = np.zeros((texts, bands), np.uint64)
    for k in range(bands):
        h = np.full(texts, k + 1, np.uint64)
        for r in range(rows):
            h = mix64(h * np.uint64(0xD6E8FEB86659FD93) + minima[k * rows + r])
        band[:, k] = h
    return key, size, band, np.ascontiguousarray((minima >> np.uint32(8)).astype(np.uint8).T)


def _signer(bands: int, rows: int, n: int):
    def signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128, "text"):
            key, size, band, seen = sign(batch.column("text"), bands, rows, n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * bands), pa.array(band.ravel().view(np.int64)))
            yield pa.record_batch([batch.column("doc_id"), batch.column("row_hash"), pa.array(key.view(np.int64)), pa.array(size), lists, pa.array([r.tobytes() for r in seen], pa.binary())], names=["doc_id", "row_hash", "key", "grams", "bands", "seen"])

    return signer


def loose_agreement(similarity: float, hashes: int) -> float:
    """The share of agreeing minima that a pair at ``similarity`` reaches but for eight standard deviations."""
    return max(0.0, similarity - 8 * math.sqrt(similarity * (1 - similarity) / hashes))


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _near_centre(loose: float):
    def near_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_bytes(batch.column("seen")) == _bytes(batch.column("centre_seen"))).mean(axis=1) >= loose
                yield batch.select(["key", "centre"]).rename_columns(["src", "dst"]).filter(pa.array(near))

    return near_centre


def _edges(mine: np.ndarray, mine_seen: np.ndarray, family: np.ndarray, seen: np.ndarray, loose: float, forest: Forest) -> list[tuple]:
    """Edges, new to ``forest``, between families that hold loosely agreeing classes."""
    near = np.zeros((len(mine), len(family)), bool)
    for k in range(len(mine)):
        other = np.flatnonzero(family != mine[k])
        near[k, other] = (seen[other] == mine_seen[k]).mean(axis=1) >= loose
    return [e for e in touching(near, mine, family) if forest.join(*e)]


def _within(loose: float):
    """Edges of buckets that are a block at most of each kind: what the commonest family doesn't hold, against all."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ("band",)):
            out, family, seen = t.column("out").to_numpy(zero_copy_only=False), t.column("family").to_numpy(), _bytes(t.column("seen"))
            edges = _edges(family[out], seen[out], family, seen, loose, Forest())
            if edges:
                yield pa.record_batch([pa.array(c) for c in zip(*edges, strict=True)], names=["src", "dst"])

    return within


def _write_blocks(folder: str):
    def write_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = BlockFile(folder)
        for t in runs(batches, ("band", "block")):
            place = file.add(t.column("block")[0].as_py(), t.select(["family", "seen"]))
            yield pa.record_batch([t.column("band")[:1], pa.array([place], PLACED)], names=["band", "place"])
        file.close()

    return write_blocks


def _across(loose: float, folder: str):
    """Edges of rows of work: a block of a large bucket, against blocks of what the commonest family doesn't hold."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = file_system(folder)

        def block(place: dict) -> tuple[np.ndarray, np.ndarray]:
            t = read_block(files, place)
            return t.column("family").to_numpy(), _bytes(t.column("seen"))

        for batch in batches:
            for row in batch.to_pylist():
                one, forest = block(row["one"]), Forest()
                edges = [e for place in row["others"] for e in _edges(*one, *block(place), loose, forest)]
                if edges:
                    yield pa.record_batch([pa.array(c) for c in zip(*edges, strict=True)], names=["src", "dst"])

    return across


def families_of(classes: DataFrame, loose: float) -> DataFrame:
    """(node, component): classes (key, bands, seen) connected by pairs of one bucket that agree at a share ``loose`` of their minima at least.

    First each class is held against its bucket's centre, the least key: one row a class and band. Then only buckets where some
    classes belong to other families than most do are looked at again: these others, in blocks, are held against all of the bucket.
    """
    memberships = classes.select("key", F.explode("bands").alias("band"))
    buckets = memberships.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("centre")).where("m > 1")
    crowded = memberships.join(buckets, "band").join(classes.select("key", "seen"), "key")
    centres = classes.select(F.col("key").alias("centre"), F.col("seen").alias("centre_seen"))
    crowded = materialise(crowded.select("band", "m", "centre", "key", "seen"), "crowded")
    stars = crowded.where("key <> centre").join(centres, "centre").select("key", "centre", "seen", "centre_seen")
    families = components(stars.mapInArrow(_near_centre(loose), "src long, dst long"))
    # classes that their bucket's commonest family doesn't hold
    told = crowded.where("m > 2").join(families.withColumnRenamed("node", "key"), "key", "left").withColumn("family", F.coalesce("component", "key"))
    common = told.groupBy("band", "family").agg(F.count(F.lit(1)).alias("n")).groupBy("band").agg(F.max_by("family", F.struct("n", "family")).alias("top"), F.max("n").alias("tops"), (F.sum("n") - F.max("n")).alias("outs"))
    mixed = told.join(common.where("outs > 0"), "band").withColumn("out", F.col("family") != F.col("top"))
    mixed = materialise(mixed.select("band", "out", "tops", "outs", "key", "family", "seen"), "mixed")
    small = F.greatest("tops", "outs") <= shared.BLOCK
    more = mixed.where(small).select("band", "out", "family", "seen").repartition("band").sortWithinPartitions("band").mapInArrow(_within(loose), "src long, dst long")
    large = mixed.where(~small)
    if not large.isEmpty():
        blocks = F.ceil(F.when(F.col("out"), F.col("outs")).otherwise(F.col("tops")) / shared.BLOCK)
        dealt = large.select("band", numbered(F.col("out").cast("long"), blocks).alias("block"), "family", "seen").repartition("band", "block").sortWithinPartitions("band", "block")
        folder = new_folder(classes, "buckets")
        places = materialise(dealt.mapInArrow(_write_blocks(folder), f"band long, place {PLACE}"), "places")
        one, other = (places.select("band", F.col("place").alias(c)) for c in ("one", "other"))
        # out blocks have the greater numbers; the commonest family's classes need no comparison among themselves
        pairs = one.join(other.where(F.shiftright("other.block", 32) > 0), "band").where("other.block >= one.block")
        more = more.union(meetings(pairs, "band", F.col("one.block")).mapInArrow(_across(loose, folder), "src long, dst long"))
    more = materialise(more, "more")
    if more.isEmpty():
        return families
    return components(families.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more))


def intersections(sets: list[np.ndarray], others: list[np.ndarray] | None = None, step: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets with others (None: with each other), by products of blocks of their membership tables; n-grams that no two share are left out."""

    def listed(of: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint64), *of]), np.repeat(np.arange(len(of)), [len(x) for x in of])

    gram, owner = listed(sets)
    kinds, code, count = np.unique(gram, return_inverse=True, return_counts=True)
    if others is None:
        useful = count > 1
    else:
        gram_b, owner_b = listed(others)
        place = np.searchsorted(kinds, gram_b)
        met = (place < len(kinds)) & (kinds[np.minimum(place, len(kinds) - 1)] == gram_b) if len(kinds) else np.zeros(len(gram_b), bool)
        code_b, owner_b = place[met], owner_b[met]
        useful = np.zeros(len(kinds), bool)
        useful[code_b] = True
    number = np.cumsum(useful) - 1

    def columns(code: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = useful[code]
        code, owner = number[code[keep]], owner[keep]
        order = np.argsort(code, kind="stable")
        return code[order], owner[order]

    def table(code: np.ndarray, owner: np.ndarray, rows: int, at: int, width: int) -> np.ndarray:
        a, b = np.searchsorted(code, (at, at + width))
        out = np.zeros((rows, width), np.float32)
        out[owner[a:b], code[a:b] - at] = 1
        return out

    left = columns(code, owner)
    right = left if others is None else columns(code_b, owner_b)
    out = np.zeros((len(sets), len(sets if others is None else others)), np.float32)
    n = int(useful.sum())
    for at in range(0, n, step):
        width = min(step, n - at)
        one = table(*left, len(sets), at, width)
        out += one @ (one if others is None else table(*right, len(others), at, width)).T
    return out


def _near(similarity: float):
    def near(one: pa.Array, other: pa.Array | None) -> np.ndarray:
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in c] if c is not None else None for c in (one, other))
        both = intersections(a, b)
        n, m = (np.array([len(x) for x in c], np.float64) for c in (a, a if b is None else b))
        return both >= similarity * (n[:, None] + m - both) - 1e-6

    return near


def _grams(n: int):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # rows alike in doc_id and text are read once a task
        for batch in slices(batches, 128, "text"):
            new = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in met:
                    met.add(key)
                    new.append(i)
            batch = batch.take(pa.array(new, pa.int64()))
            found, ends = shingles(batch.column("text"), n)
            sets = [np.unique(found[a:b]).tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.record_batch([batch.column(c) for c in DEALT] + [pa.array(sets, pa.binary())], names=[*DEALT, "payload"])

    return grams


def _linked(docs: DataFrame, n: int, similarity: float, recall: float, most_hashes: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all rows, and per class that has a link: key, links, component (a key)."""
    spark = docs.sparkSession
    small_batches(spark)
    bands, rows = choose_bands(similarity, recall, most_hashes)
    doc_id = F.col("doc_id").cast("long")
    base = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("row_hash"), "text")
    signed = materialise(base.mapInArrow(_signer(bands, rows, n), "doc_id long, row_hash long, key long, grams long, bands array<long>, seen binary"), "signed")
    classes = signed.where("grams > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("row_hash").alias("row_hash"), F.first("grams").alias("grams"), F.first("bands").alias("bands"), F.first("seen").alias("seen"))
    classes = materialise(classes, "classes")
    repeats = not signed.where("grams > 0").groupBy("row_hash").count().where("count > 1").isEmpty()
    families = families_of(classes, loose_agreement(similarity, bands * rows))
    # 3: verify within families
    known = families.join(classes.select(F.col("key").alias("node"), "copies", "row_hash", "grams"), "node")
    # sets of sizes more than a bin apart can't be similar; the bins are a little wider than that takes, against rounding
    known = known.withColumn("bin", F.floor(F.log("grams") / (1.001 * -math.log(similarity))) if 0 < similarity < 1 else F.lit(0))
    blocks = lambda n, grams: F.ceil(F.greatest(n / shared.BLOCK, grams * 8 / shared.BLOCK_BYTES))
    bins = known.groupBy("component", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("grams").alias("all_grams"))
    sizes = bins.groupBy("component").agg((blocks(F.sum("n"), F.sum("all_grams")) > 1).alias("wide"))
    placed = known.join(sizes, "component").join(bins, ["component", "bin"]).withColumn("blocks", F.when(F.col("wide"), blocks(F.col("n"), F.col("all_grams"))).otherwise(1))
    placed = placed.select("component", "wide", F.when(F.col("wide"), F.col("bin")).otherwise(0).alias("bin"), "blocks", F.col("node").alias("key"), "copies", "row_hash")
    wanted = broadcast_if_small(materialise(placed, "wanted"))
    read = base.select("row_hash", "text").join(wanted, "row_hash").select(*DEALT, "text").mapInArrow(_grams(n), "component long, wide boolean, bin long, blocks long, key long, copies long, payload binary")
    counts, edges = count_links(read.dropDuplicates(["key"]) if repeats else read, _near(similarity))
    return signed, counts.join(components(edges).withColumnRenamed("node", "key"), "key", "left").select("key", "links", F.coalesce("component", "key").alias("component"))


def _labelled(docs: DataFrame, n: int, similarity: float, recall: float, most_hashes: int) -> DataFrame:
    signed, linked = _linked(docs, n, similarity, recall, most_hashes)
    rows = signed.select("doc_id", "row_hash", F.when(F.col("grams") > 0, F.col("key")).alias("key"))
    return grouped(rows, linked, "doc_id").drop("key")


def link(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """Per document: doc_id, class_id (of its group of near copies: the smallest doc_id reachable by links), n_links (other documents linked with it), component_id (as class_id), kept (doc_id = component_id), copies_id (smallest doc_id with the same n-grams)."""
    found = _labelled(docs, n, similarity, recall, most_hashes)
    return found.select("doc_id", F.col("component_id").alias("class_id"), "n_links", "component_id", "kept", "copies_id")


def one_of_each(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """The documents, with all their columns, one of each component: that with the smallest doc_id."""
    found = materialise(_labelled(docs, n, similarity, recall, most_hashes), "labelled")
    counts = found.groupBy("row_hash").agg(F.count(F.lit(1)).alias("rows"), F.min("kept").alias("kept"))
    special = materialise(counts.where("rows > 1 or not kept"), "special")
    hashed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row_hash"))
    once = hashed.join(broadcast_if_small(special.select("row_hash")), "row_hash", "left_anti")
    repeated = special.where("rows > 1 and kept").select("row_hash")  # equal rows, ids included
    if repeated.isEmpty():
        return once.select("doc.*")
    again = hashed.join(broadcast_if_small(repeated), "row_hash", "left_semi")
    wordy = F.coalesce(F.col("doc.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return once.unionByName(again.where(wordy).dropDuplicates(["row_hash"])).unionByName(again.where(~wordy)).select("doc.*")
