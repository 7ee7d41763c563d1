"""Operator 4: mixture-controlled packing of documents into sequences, by deficit round-robin over source queues.

Each source is a queue of its documents' ids, an end id after each document. Round r gives every queue
the quantum ``length`` * (its ids / all ids); what a quantum has beyond whole ids is the queue's deficit and is
carried to the next round, however many windows and partitions lie between. After r rounds a queue has
therefore given floor(r * quantum) ids, which any task works out alone: no round waits for another. The rounds' ids,
queue after queue, make one run that is cut into sequences of ``length``; each is within one id a queue of the target
proportions, only the last sequence of all is padded, and all queues end in the last round.

Every source has its queue. With more than ``FAN`` sources the largest have queues at the root, and the others are queues
of queues: groups of groups, ``FAN`` side by side, take turns by the same rule in rounds of ``GRAIN`` ids a queue, and what they give is one
queue of the root. So a source's share is met at each level, and a task knows ``FAN`` totals a level, however many sources there are.

Cases: null text is empty and gives the end id alone; a null source is a source; an empty table gives no
rows. Rows with equal doc_ids are documents of their own. Long texts are cut like any others. Extra
columns are left out.

Scale: the texts are encoded once, where they are read, to a table of ids; that table isn't shuffled. Each
of its partitions notes how many ids of a source came earlier in it, so that prefix sums need one row for
each partition and source only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise, slices, small_batches
from .token_ids import REMEMBERED

LENGTH = 2048
#: Queues side by side, and ids a queue in a round of queues that together are one queue of those above.
FAN, GRAIN = 64, 64
ENCODED = "doc_id long, source string, part int, seq long, before long, doc_tokens long, width int, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


def muldiv(a: np.ndarray, b: int, c: int) -> np.ndarray:
    """floor(a * b / c) of integers below 2^62 with a quotient below 2^50, the product as long as it likes."""
    a = np.asarray(a, np.int64)
    q = (a.astype(np.float64) * (float(b) / float(c))).astype(np.int64)
    with np.errstate(over="ignore"):
        rest = (a.astype(np.uint64) * np.uint64(b) - q.astype(np.uint64) * np.uint64(c)).astype(np.int64)
    return q + rest // np.int64(c)


def _encode(tokenizer: str, end: int, remembered: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .token_ids import encoder

        part, given, seq = TaskContext.get().partitionId(), {}, 0
        for batch in slices(batches, 128, "text"):
            codes = encoder(tokenizer, remembered)
            width = 2 if max(codes.library.get_vocab_size(True) - 1, end) < 2**16 else 4
            ids, sizes = codes.encode(batch.column("text").to_pylist(), end)
            before = []
            for source, n in zip(batch.column("source").to_pylist(), sizes.tolist(), strict=True):
                before.append(given.get(source, 0))
                given[source] = before[-1] + n
            offsets = np.concatenate([[0], np.cumsum(sizes)]) * width
            data = pa.py_buffer(np.ascontiguousarray(ids.astype(f"<u{width}")))
            packed = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), data]).cast(pa.binary())
            n = batch.num_rows
            yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seq, seq + n)), pa.array(before, pa.int64()), pa.array(sizes), pa.array(np.full(n, width, np.int32)), packed], names=["doc_id", "source", "part", "seq", "before", "doc_tokens", "width", "ids"])
            seq += n

    return encode


def climb(queue: np.ndarray, first: np.ndarray, n: np.ndarray, totals: list[int], length: int) -> tuple[np.ndarray, ...]:
    """Where the ids first .. first + n - 1 of queues come in the run of rounds of ``length`` ids that the queues make: interval, place in its queue, size, place in the run."""
    everything = sum(totals)
    of, lo = [], []
    for s, total in enumerate(totals):
        own = np.flatnonzero(queue == s)
        if not len(own):
            continue
        if total * length >= everything:  # at least an id a round: cut where rounds begin
            r0, r1 = (_round_of(x, total, everything, length) for x in (first[own], first[own] + n[own] - 1))
            k = r1 - r0
            where = np.repeat(own, k)
            r = np.repeat(r0, k) + 1 + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at = np.minimum(muldiv(r, total * length, everything), total)
        else:  # no round has two ids of this queue
            where = np.repeat(own, n[own] - 1)
            at = np.repeat(first[own], n[own] - 1) + 1 + np.arange(len(where)) - np.repeat(np.cumsum(n[own] - 1) - (n[own] - 1), n[own] - 1)
        of += [own, where]
        lo += [first[own], at]
    if not of:
        return (np.zeros(0, np.int64),) * 4
    of, lo = np.concatenate(of), np.concatenate(lo)
    order = np.lexsort((lo, of))
    of, lo = of[order], lo[order]
    stop = np.append(lo[1:], 0)
    ends = np.append(of[1:] != of[:-1], True)
    stop[ends] = (first + n)[of[ends]]
    size, q = stop - lo, queue[of]
    r = np.zeros(len(lo), np.int64)
    for s, total in enumerate(totals):
        if total:
            r[q == s] = _round_of(lo[q == s], total, everything, length)
    rounds, back = np.unique(r, return_inverse=True)
    place = np.zeros(len(lo), np.int64)
    for s, total in enumerate(totals):
        if not total:
            continue
        a, b = (np.minimum(muldiv(x, total * length, everything), total) for x in (rounds, rounds + 1))
        place += a[back]
        place += np.where(q > s, (b - a)[back], np.where(q == s, lo - a[back], 0))
    return of, lo, size, place


def cut(queue: np.ndarray, first: np.ndarray, n: np.ndarray, totals: list[int], length: int, below: list | None = None) -> tuple[np.ndarray, ...]:
    """The pieces of documents that hold the ids first .. first + n - 1 of their queues: document, start in it, length, place in the run.

    below: for each document None, or the levels between its source's queue and the root's queue ``queue``, lowest first: (number among its siblings, their totals).
    """
    doc, start = np.arange(len(n)), np.zeros(len(n), np.int64)
    alike: dict = {}
    for i, levels in enumerate(below or ()):
        if levels:
            alike.setdefault(tuple((k, tuple(t)) for k, t in levels), []).append(i)
    if alike:
        deep = np.concatenate([np.array(x) for x in alike.values()])
        parts = [[x[np.setdiff1d(doc, deep)] for x in (doc, start, queue, first, n)]]
        for levels, own in alike.items():
            own = np.array(own)
            d, s, f, k = own, np.zeros(len(own), np.int64), first[own], n[own]
            for number, siblings in levels:
                of, lo, size, place = climb(np.full(len(f), number), f, k, list(siblings), GRAIN * len(siblings))
                d, s, f, k = d[of], s[of] + lo - f[of], place, size
            parts.append([d, s, queue[d], f, k])
        doc, start, queue, first, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    of, lo, size, place = climb(queue, first, n, totals, length)
    doc, start = doc[of], start[of] + lo - first[of]
    over = place // length != (place + size - 1) // length  # a piece meets one end of a sequence at most
    head = length - place[over] % length
    tail = size[over] - head
    size[over] = head
    doc, start, size, place = (np.concatenate(x) for x in ((doc, doc[over]), (start, start[over] + head), (size, tail), (place, place[over] + head)))
    return doc, start, size, place


def _round_of(j: np.ndarray, total: int, everything: int, length: int) -> np.ndarray:
    """The round that gives a queue's id j: the last r with floor(r * total * length / everything) <= j."""
    r = muldiv(j + 1, everything, total * length)
    r = np.maximum(r - 2, 0)
    for _ in range(4):
        r = np.where(muldiv(r + 1, total * length, everything) <= j, r + 1, r)
    return r


def _pieces(totals: list[int], length: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_ids import encoder

        encoder.cache_clear()  # a worker that has encoded needs its words no more
        for batch in slices(batches, 128, "ids"):
            queue, first, n, width = (batch.column(c).to_numpy() for c in ("queue", "first", "doc_tokens", "width"))
            levels = batch.column("levels")
            below = None if levels.null_count == len(levels) else [x and [(y["number"], y["totals"]) for y in x] for x in levels.to_pylist()]
            doc, start, size, place = cut(queue, first, n, totals, length, below)
            raw = batch.column("ids")
            wide = [memoryview(np.frombuffer(raw[i].as_buffer(), f"<u{w}").astype("<u4")).cast("B") for i, w in enumerate(width.tolist())]
            sums = [zlib.crc32(wide[d][4 * a : 4 * (a + k)]) for d, a, k in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
            take = pa.array(doc)
            yield pa.record_batch([batch.column("doc_id").take(take), pa.array(start), pa.array(size), pa.array(sums, pa.int64()), batch.column("doc_tokens").take(take), pa.array(place // length), pa.array(place % length), batch.column("source").take(take)], names=[x.split()[0] for x in PIECES.split(", ")])

    return pieces


def source_levels(sources: DataFrame, n: int, fan: int) -> DataFrame:
    """source, levels (array of (number, totals of the siblings), lowest first) of ``n`` sources (source, tokens) that share one queue of the root.

    Sources are dealt by hash to groups of ``fan`` groups and so on, until a group has some ``fan`` sources, which are its queues by code point.
    """
    depth = 0
    while n > fan ** (depth + 1):
        depth += 1
    groups = [f"g{d}" for d in range(depth)]
    dealt = sources.withColumns({g: F.pmod(F.xxhash64("source", F.lit(d)), F.lit(fan)).cast("int") for d, g in enumerate(groups)})
    own = dealt.groupBy(*groups).agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("members"), F.sum("tokens").alias("tokens"))
    found = own.select(*groups, "tokens", F.posexplode("members").alias("number", "member"), F.transform("members", lambda m: m["tokens"]).alias("totals"))
    found = found.select(*groups, F.col("member.source").alias("source"), F.array(F.struct(F.col("number").cast("int").alias("number"), "totals")).alias("levels"))
    sums = own.select(*groups, "tokens")
    for d in reversed(range(depth)):
        above, g = groups[:d], groups[d]
        held = sums.groupBy(*above).agg(F.map_from_entries(F.collect_list(F.struct(g, "tokens"))).alias("held"), F.sum("tokens").alias("tokens"))
        totals = held.select(*above, F.transform(F.sequence(F.lit(0), F.lit(fan - 1)), lambda k: F.coalesce(F.try_element_at("held", k), F.lit(0))).alias("totals"))
        found = found.join(totals, above) if above else found.withColumn("g", F.lit(0)).join(F.broadcast(totals.withColumn("g", F.lit(0))), "g").drop("g")  # the root has one row
        found = found.withColumn("levels", F.concat("levels", F.array(F.struct(F.col(g).alias("number"), "totals")))).drop("totals", g)
        sums = held.select(*above, "tokens")
    return found.select("source", "levels")


def pack(docs: DataFrame, tokenizer: str, end: int = 1, length: int = LENGTH, fan: int = FAN, remembered: int = REMEMBERED) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source.

    ``remembered`` bounds the words that a worker remembers: more are faster and take more of its memory.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    coded = materialise(rows.mapInArrow(_encode(tokenizer, end, remembered), ENCODED), "encoded")
    sums = materialise(coded.groupBy("source", "part").agg(F.sum("doc_tokens").alias("tokens")), "sums")
    per_source = sums.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    largest = per_source.orderBy(F.col("tokens").desc(), F.col("source").asc_nulls_last()).limit(fan + 1).collect()
    own = largest if len(largest) <= fan else largest[: fan - 1]
    totals = [r["tokens"] for r in own]
    queues = F.broadcast(spark.createDataFrame([(r["source"], k) for k, r in enumerate(own)], "source string, queue long"))
    same = lambda one, other: F.col(f"{one}.source").eqNullSafe(F.col(f"{other}.source"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.withColumn("part_first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).alias("s").join(queues.alias("q"), same("s", "q"), "left").select("s.source", "part", "part_first", F.coalesce("queue", F.lit(len(own))).alias("queue"))
    if len(own) < len(largest):
        rest = materialise(per_source.alias("s").join(queues.alias("q"), same("s", "q"), "left_anti"), "rest")
        counted = rest.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens")).first()
        totals.append(counted["tokens"])
        levels = source_levels(rest, counted["n"], fan)
        firsts = firsts.alias("s").join(levels.alias("q"), same("s", "q"), "left").select("s.*", "levels")
    else:
        firsts = firsts.withColumn("levels", F.lit(None).cast("array<struct<number: int, totals: array<bigint>>>"))
    firsts = broadcast_if_small(materialise(firsts, "firsts"))  # a row for each partition and source
    placed = coded.alias("c").join(firsts.alias("f"), (F.col("c.part") == F.col("f.part")) & same("c", "f"))
    placed = placed.select("doc_id", "c.source", "queue", (F.col("part_first") + F.col("before")).alias("first"), "doc_tokens", "width", "ids", "levels")
    return placed.mapInArrow(_pieces(totals, length), PIECES)
