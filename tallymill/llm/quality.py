"""Operator 6: a quality classifier that lets the nearest labelled documents vote, in a latent-semantic space.

Terms. A text counts in three groups of terms, each taken by square roots and scaled to length 1: runs of three
byte classes (lower vowel, other lower letter, upper letter, digit, space, line end, and so on); hashed words, weighted by how rare they are; and
what tells the shape of a text: bins of the shares of repeated words, of words that repeat the one before, of
upper-case letters and of marks, of mean word length and of length. The whole text is counted.

Space. Of the labelled rows that aren't held out some ``SAMPLE`` are learned from, chosen by a hash (none longer than ``LONGEST`` bytes, ``SAMPLE_BYTES`` in all); the singular value
decomposition of their terms gives the space, ``RANK`` wide. Their vectors and labels, at most
``1.5 * SAMPLE * RANK`` numbers, go to every task; that bound doesn't grow with the tables.

Votes. Blocks of documents meet all labelled vectors in one product: exact cosines. The ``NEAREST`` largest vote
for their labels with weight cosine^``SHARPNESS``, and the sample's share of label 1 is one more
weak vote, which alone decides for texts without terms.

Cases: null and empty texts get the sample's share; without any label to learn from all scores are 0.5. Several labels of one doc_id are
samples each. Repeated rows score alike. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import held_out, materialise, slices, small_batches, text_bytes, word_hashes

SAMPLE = 4000
#: Bounds of what is learned from, in bytes: of one text, and of the whole sample. Neither bounds what is scored.
LONGEST, SAMPLE_BYTES = 1 << 18, 64 << 20
RANK = 48
NEAREST = 24
SHARPNESS = 8
PRIOR = 0.02
WORDS = 2048
SHAPES = 6 * 16
SHARES = 1 << 20


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 13)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            kind[b] = 12
        elif c.islower():
            kind[b] = 0 if c in "aeiouy" else 1
        elif c.isupper():
            kind[b] = 2
        elif c.isdigit():
            kind[b] = 3
        elif c == "\n":
            kind[b] = 5
        elif c.isspace():
            kind[b] = 4
        elif c in ".,":
            kind[b] = 6
        elif c in ";:'\"-()":
            kind[b] = 7
        elif c == "|":
            kind[b] = 8
        elif c in "!?":
            kind[b] = 9
        elif c in "#$%&*@":
            kind[b] = 10
        elif c in "<>[]{}/\\=_+":
            kind[b] = 11
    return kind


KIND = _byte_classes()
KINDS = 14
RUNS = KINDS**3
TERMS = RUNS + WORDS + SHAPES


def _scaled(x: np.ndarray) -> np.ndarray:
    np.sqrt(x, out=x)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def terms(data: np.ndarray, offsets: np.ndarray, rarity: np.ndarray | None = None, step: int = 1 << 20) -> np.ndarray:
    """A row of ``TERMS`` weights for each text; texts without a byte have none. Bytes are counted ``step`` at a time."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    runs = np.zeros(n * RUNS)
    upper, lower, marks = np.zeros(n), np.zeros(n), np.zeros(n)
    for at in range(0, len(data), step):
        kind = KIND[data[at : at + step + 2]]
        row = np.searchsorted(offsets, np.arange(at, at + len(kind)), side="right") - 1
        if len(kind) > 2:
            three = (kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:]
            first = row[0]
            inside = row[:-2] == row[2:]
            found = np.bincount((row[:-2] - first)[inside] * RUNS + three[inside])
            runs[first * RUNS : first * RUNS + len(found)] += found
        kind, row = kind[:step], row[:step]
        for counts, m in ((upper, kind == 2), (lower, (kind < 2) | (kind == 12)), (marks, (kind >= 8) & (kind != 12))):
            counts += np.bincount(row[m], minlength=n)
    runs = runs.astype(np.float32).reshape(n, RUNS)
    words, bounds = word_hashes(data, offsets)
    count = np.diff(bounds)
    of = np.repeat(np.arange(n), count)
    bag = np.bincount(of * WORDS + (words >> np.uint64(20)).astype(np.int64) % WORDS, minlength=n * WORDS).astype(np.float32).reshape(n, WORDS)
    key = np.sort((words & np.uint64(0xFFFFFFFF)) | (of.astype(np.uint64) << np.uint64(32)))
    again = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n) if len(key) else np.zeros(n)
    twice = np.bincount(of[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])], minlength=n) if len(words) else np.zeros(n)
    some = np.maximum(count, 1)
    shares = [again / some, twice / some, upper / np.maximum(upper + lower, 1), marks / np.maximum(sizes, 1), np.minimum(sizes / some / 24, 1), np.minimum(np.log2(sizes + 1) / 20, 1)]
    shape = np.zeros((n, SHAPES), np.float32)
    for k, share in enumerate(shares):  # a share lies between two bins and counts in both
        at = np.minimum(np.sqrt(share) if k < 4 else share, 1) * 14.999
        low = at.astype(np.int64)
        shape[np.arange(n), 16 * k + low] = 1 - (at - low)
        shape[np.arange(n), 16 * k + low + 1] = at - low
    shape[sizes == 0] = 0
    if rarity is not None:
        bag *= rarity
    return np.concatenate([_scaled(runs), _scaled(bag), _scaled(shape)], axis=1, dtype=np.float32)


class Voters:
    """The latent space and the labelled vectors in it."""

    def __init__(self, texts: list[str], label: list[int], rank: int = RANK):
        raw = [t.encode() for t in texts]
        blocks = [raw[a : a + 128] for a in range(0, len(raw), 128)]

        def rows(rarity: np.ndarray | None) -> Iterator[np.ndarray]:
            for block in blocks:
                offsets = np.concatenate([[0], np.cumsum([len(t) for t in block])]).astype(np.int64)
                yield terms(np.frombuffer(b"".join(block), np.uint8), offsets, rarity)

        held = sum((x[:, RUNS : RUNS + WORDS] > 0).sum(axis=0) for x in rows(None))
        self.rarity = np.log((len(texts) + 1) / (held + 1)).astype(np.float32) ** 2
        x = np.empty((len(texts), TERMS), np.float32)
        for k, part in enumerate(rows(self.rarity)):
            x[128 * k : 128 * k + len(part)] = part
        # the leading right singular vectors, by subspace iteration
        basis = np.linalg.qr(x.T @ np.random.default_rng(5).standard_normal((len(x), min(rank + 8, len(x)))).astype(np.float32))[0]
        for _ in range(6):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        self.basis = (basis @ turn.T)[:, :rank].astype(np.float32)
        self.vectors = self._unit(x @ self.basis)
        self.label = np.array(label, np.float32)
        self.share = float(self.label.mean())

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)

    def score(self, data: np.ndarray, offsets: np.ndarray, block: int = 128) -> np.ndarray:
        """The share of the votes for label 1, block by block."""
        out = np.empty(len(offsets) - 1)
        k = min(NEAREST, len(self.label))
        for at in range(0, len(out), block):
            part = offsets[at : at + block + 1]
            mine = self._unit(terms(data[part[0] : part[-1]], part - part[0], self.rarity) @ self.basis)
            cosine = mine @ self.vectors.T
            near = np.argpartition(cosine, len(self.label) - k, axis=1)[:, len(self.label) - k :]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** SHARPNESS
            ones = (weight * self.label[near]).sum(axis=1)
            out[at : at + block] = (ones + PRIOR * self.share) / (weight.sum(axis=1) + PRIOR)
        return out


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list:
    """Rows (text, label) to learn from: about ``most`` of those that have a label and aren't held out; rows alike in doc_id, text and label count once."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "quality")
    n = known.count()
    if not n:
        return []
    share = min(SHARES, SHARES * most // n + 1)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)) < share).orderBy(F.xxhash64("doc_id"), "quality").limit(int(1.5 * most))
    texts = docs.select("doc_id", "text").where(F.octet_length("text") <= LONGEST).join(F.broadcast(picked), "doc_id").withColumn("hash", F.xxhash64("text"))
    # which ones by hash and size alone; only their texts are gathered then
    sized = texts.select("doc_id", "hash", "quality", F.octet_length("text").alias("size")).distinct()
    first = sized.orderBy("hash", "quality", "doc_id").limit(int(1.5 * most))
    upto = F.sum("size").over(Window.orderBy("hash", "quality", "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over the few rows of the sample
    chosen = materialise(first.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("doc_id", "hash", "quality"), "chosen")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "hash", "quality"], "left_semi").groupBy("doc_id", "hash", "quality").agg(F.first("text").alias("text"))
    return sorted(map(tuple, rows.select("text", "quality").collect()))


def train(docs: DataFrame, labels: DataFrame) -> Voters | None:
    rows = sample(docs, labels)
    return Voters([t for t, _ in rows], [y for _, y in rows]) if rows else None


def _score_column(voters: Voters | None, text: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(text)
    return np.full(len(offsets) - 1, 0.5) if voters is None else voters.score(data, offsets)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted."""
    small_batches(docs.sparkSession)
    voters = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "text"):
            if batch.num_rows:
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(_score_column(voters.value, batch.column("text")))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    found = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, with all their columns, that score ``least`` or more."""
    small_batches(docs.sparkSession)
    voters = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "text"):
            if batch.num_rows:
                yield batch.filter(pa.array(_score_column(voters.value, batch.column("text")) >= least))

    return docs.mapInArrow(keep, docs.schema)
