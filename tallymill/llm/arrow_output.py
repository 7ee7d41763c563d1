"""Operator 8: token ids as Arrow stream files with fixed-size-list batches.

Documents in ascending doc_id order (null first; rows with equal ids by their text) are encoded whole, an end id is appended to
each, and the ids of a range of documents run on through sequences of equal length in one file:

    part-00007.tokens.arrows   ids fixed_size_list<uint16 or uint32>[length], mask fixed_size_list<bool>[length]
    part-00007.docs.arrows     doc_id, start (ids of the file's earlier documents), n_tokens

Ids take 16 bits where the tokenizer's vocabulary allows it. The last sequence of a file is padded with
id 0 and false in its mask. Files are not compressed: a mapped file gives any sequence without copying.

Recovery: a task writes under a name of its own and renames it when complete, so a repeated task replaces
equal bytes; what was written is a table (the manifest) before anything is read. Files live in the shared
folder (``spark.checkpoint.dir``) or in ``folder``, by any URI that Arrow's file systems know.

Cases: null text is an empty one, which gives the end id alone. An empty table gives no file and no row.
Extra columns are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import crc, each_in_a_task, materialise, shared_dir, slices, small_batches

LENGTH = 2048
BATCH_SEQUENCES = 256
#: Files that hold the manifest, whose rows are few and short; else each token file's task would write one of its own.
MANIFEST_PARTS = 4
MANIFEST = "part int, folder string, docs_path string, tokens_path string, docs long, tokens long, sequences long"
FOUND = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"


def file_system(uri: str):
    """Arrow's file system for a folder's URI or path, and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Cuts a run of ids into equal sequences and writes them as record batches; holds one batch at most."""

    def __init__(self, sink, width: np.dtype, length: int):
        self.length, self.width = length, width
        self.kind = pa.list_(pa.from_numpy_dtype(width), length)
        self.schema = pa.schema([("ids", self.kind), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = self.sequences = 0

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.stream.write_batch(pa.record_batch(lists, schema=self.schema))
        self.sequences += len(ids) // self.length

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.width))
        self.n_held += len(ids)
        step = self.length * BATCH_SEQUENCES
        if self.n_held >= step:
            run = np.concatenate(self.held)
            for at in range(0, len(run) - step + 1, step):
                self._write(run[at : at + step], step)
            self.held = [run[len(run) // step * step :]]
            self.n_held = len(self.held[0])

    def close(self) -> None:
        run = np.concatenate(self.held) if self.held else np.zeros(0, self.width)
        if len(run):
            padded = np.zeros(-(-len(run) // self.length) * self.length, self.width)
            padded[: len(run)] = run
            self._write(padded, len(run))
        self.stream.close()


def _writer(folder: str, tokenizer: str, end: int, length: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .token_ids import encoder

        part = TaskContext.get().partitionId()
        own = f".attempt-{uuid.uuid4().hex}"
        files, base = file_system(folder)
        names = [f"{base}/part-{part:05d}.{kind}.arrows" for kind in ("docs", "tokens")]
        codes = tokens = docs = index = None
        total = n_docs = 0
        for batch in slices(batches, 512, "text"):
            if codes is None:
                codes = encoder(tokenizer)
                width = np.dtype(np.uint16 if max(codes.library.get_vocab_size(True) - 1, end) < 2**16 else np.uint32)
                files.create_dir(base, recursive=True)
                sinks = [files.open_output_stream(n + own) for n in names]
                tokens = SequenceWriter(sinks[1], width, length)
                index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
                docs = pa.ipc.new_stream(sinks[0], index)
            ids, sizes = codes.encode(batch.column("text").to_pylist(), end)
            tokens.add(ids)
            starts = total + np.cumsum(sizes) - sizes
            docs.write_batch(pa.record_batch([batch.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=index))
            total += int(sizes.sum())
            n_docs += batch.num_rows
        if codes is not None:
            tokens.close()
            docs.close()
            for sink, name in zip(sinks, names, strict=True):
                sink.close()
                files.move(name + own, name)
            row = [[part], [folder], [names[0]], [names[1]], [n_docs], [total], [tokens.sequences]]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "folder", "docs_path", "tokens_path", "docs", "tokens", "sequences"])

    return write


def write(docs: DataFrame, tokenizer: str, end: int = 1, length: int = LENGTH, folder: str | None = None) -> DataFrame:
    """Write the files; the manifest, one row a file: part, folder, docs_path, tokens_path, docs, tokens, sequences."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = ordered.mapInArrow(_writer(folder, tokenizer, end, length), MANIFEST)
    return materialise(manifest.repartition(MANIFEST_PARTS), "manifest")


def sequences(files, path: str, counts=None) -> Iterator[np.ndarray]:
    """The ids of a file, a batch at a time, without the padding."""
    with pa.ipc.open_stream(files.open_input_file(path)) as stream:
        for batch in stream:
            ids = batch.column("ids").flatten().to_numpy()
            real = int(pc.sum(batch.column("mask").flatten()).as_py() or 0)
            yield ids[:real]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for manifest in batches:
        for row in manifest.to_pylist():
            files, _ = file_system(row["folder"])
            runs = sequences(files, row["tokens_path"])
            held, at = np.zeros(0, np.uint16), 0
            with pa.ipc.open_stream(files.open_input_file(row["docs_path"])) as index:
                for docs in index:
                    starts, sizes = (docs.column(c).to_numpy() for c in ("start", "n_tokens"))
                    stop = int(starts[-1] + sizes[-1])
                    parts = [held]
                    while at + sum(map(len, parts)) < stop:
                        parts.append(next(runs))
                    held = np.concatenate(parts)
                    wide = held[: stop - at].astype("<u4")
                    sums = [crc(wide[s - at : s - at + n]) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    held, at = held[stop - at :], stop
                    yield pa.record_batch([pa.array(np.full(len(sums), row["part"], np.int32)), docs.column("doc_id"), docs.column("start"), docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = manifest.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    found = each_in_a_task(manifest).mapInArrow(_read, FOUND)
    return found.join(firsts, "part").select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
