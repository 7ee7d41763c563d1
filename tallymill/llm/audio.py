"""Operator 7: media columns with audio features.

A document's payload is its text's UTF-8 bytes (null: none), bytes 0 appended up to a positive multiple of 64. It is
stored as the 8-bit samples of a WAV file, one channel at ``RATE``, and all else is worked out from the stored
bytes when read back:

* polyphase resampling to ``RATE * UP / DOWN``: a windowed-sinc filter, parted into ``UP`` phases, so that
  neither the zeros between samples nor samples to be dropped are ever computed;
* log-mel filterbanks over windows of ``FRAME`` samples that overlap by half;
* segments by energy with hysteresis: one opens above a document's high mark and closes below its low mark,
  each with its time span;
* clips of ``CLIP`` frames, the last filled with silence, as fixed-shape tensors with time spans.

``write_media`` stores the WAV files, ``write_clips`` reads them back and stores what is worked out from them, ``clips`` and
``digests`` read that. All are Arrow files in the shared folder with buffers compressed by zstd, one of each kind a task, written under a name of the attempt's
own and renamed when complete; clips are a fixed-shape tensor column of 16-bit floats. ``digests`` gives one row a document
with checksums of the stored bytes and a summary of the stored features.
Everything of a document is computed from that document alone, so equal texts have equal values.

Cases: null and empty texts are 64 bytes 0, silence. Repeated rows each have their row. Very long texts are longer audio, worked on by
blocks of ``FRAMES_AT_ONCE`` frames; nothing is cut. An empty table gives no files and no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_output import file_system
from .shared import each_in_a_task, materialise, shared_dir, slices, small_batches

RATE, UP, DOWN = 16_000, 5, 8
TAPS_A_PHASE = 8
FRAME, HOP, BANDS, CLIP = 256, 128, 32, 64
FLOOR = 1e-6
UNIT = 64


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes and how many are the text's."""
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file with one channel of unsigned 8-bit samples (their number must be even)."""
    form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples
    return b"RIFF" + struct.pack("<I", len(form)) + form


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and rate of a file with one channel of 8-bit samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not one channel of 8-bit samples")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A low-pass filter of up * taps values, one row for each phase, latest sample first."""
    n = up * taps
    t = (np.arange(n) - (n - 1) / 2) / max(up, down)
    h = np.sinc(t) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(taps, up).T)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS_A_PHASE, before: np.ndarray | None = None) -> np.ndarray:
    """x at up / down of its rate, delayed by half the filter; every output needs one phase's taps only. before: the taps - 1 samples ahead of x (None: silence)."""
    h = phases(up, down, taps)
    n = -(-len(x) * up // down)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1) if before is None else before, x]), taps)[:, ::-1]
    out = np.empty(n)
    for first in range(min(up, n)):  # outputs up apart are of one phase and lie down inputs apart
        place = first * down
        out[first::up] = windows[place // up :: down][: len(out[first::up])] @ h[place % up]
    return out


@lru_cache(maxsize=4)
def filterbank(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangles evenly spaced in mel, (bins, bands)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(frame // 2 + 1)[:, None] * rate / frame
    rise, fall = (f - edge[:-2]) / np.diff(edge)[:-1], (edge[2:] - f) / np.diff(edge)[1:]
    return np.maximum(0, np.minimum(rise, fall))


@lru_cache(maxsize=2)
def _window(frame: int) -> np.ndarray:
    return np.hanning(frame + 1)[:-1]


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values (frames, bands) and the log energy of each frame; the last frame is filled with silence."""
    frames = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    padded = np.zeros((frames - 1) * HOP + FRAME)
    padded[: len(x)] = x
    view = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    power = np.fft.rfft(view * _window(FRAME), axis=1)
    power = power.real**2 + power.imag**2
    return np.log(power @ filterbank(rate) + FLOOR), np.log(np.einsum("ij,ij->i", view, view) / FRAME + FLOOR)


def segments(energy: np.ndarray, high: float = 0.25, low: float = -0.25) -> list[tuple[int, int]]:
    """Frames [from, to) of each stretch that rises above mean + high spreads and ends where it falls below mean + low spreads."""
    mean, spread = energy.mean(), energy.std()
    if spread < 1e-6:
        return []
    mark = np.where(energy > mean + high * spread, 1, np.where(energy < mean + low * spread, -1, 0))
    at = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))  # the last clear word decides
    on = np.concatenate([[0], (at >= 0) & (mark[at] == 1), [0]]).astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


#: Frames that are worked on at once; their hops are a multiple of UP, so every block begins at the filter's first phase.
FRAMES_AT_ONCE = 5000


def analyse(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[float, float]], float]:
    """From a stored file: its samples, log-mel frames as 16-bit floats, spans of its segments in seconds, seconds a frame."""
    samples, rate = from_wav(media)
    raw = np.frombuffer(samples, np.uint8)
    new_rate = rate * UP / DOWN
    n = -(-len(raw) * UP // DOWN)
    frames = max(1, -(-max(0, n - FRAME) // HOP) + 1)
    mels, energies = [], []
    for at in range(0, frames, FRAMES_AT_ONCE):
        stop = min(frames, at + FRAMES_AT_ONCE)
        first, last = at * HOP, min(n, (stop - 1) * HOP + FRAME)
        lo, hi = first * DOWN // UP, min(len(raw), -(-last * DOWN // UP) + 1)
        x = (raw[max(0, lo - TAPS_A_PHASE + 1) : hi].astype(np.float64) - 128) / 128
        x = np.concatenate([np.zeros(max(0, TAPS_A_PHASE - 1 - lo)), x])
        mel, energy = log_mel(resample(x[TAPS_A_PHASE - 1 :], before=x[: TAPS_A_PHASE - 1])[: last - first], new_rate)
        mels.append(mel.astype(np.float16))
        energies.append(energy)
    step = HOP / new_rate
    return samples, np.concatenate(mels), [(a * step, b * step) for a, b in segments(np.concatenate(energies))], step


def in_clips(mel: np.ndarray) -> np.ndarray:
    """(clips, CLIP, BANDS); silence behind the end."""
    n = -(-len(mel) // CLIP)
    out = np.full((n * CLIP, mel.shape[1]), np.log(FLOOR), np.float16)
    out[: len(mel)] = mel
    return out.reshape(n, CLIP, mel.shape[1])


def summary(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, segments' spans, and for each band the mean over the frames."""
    return f"frames={len(mel)};spans={','.join(f'{a:.4f}-{b:.4f}' for a, b in spans)};mel={','.join(f'{v:.3f}' for v in mel.mean(axis=0, dtype=np.float64))}"


SPANS = pa.list_(pa.struct([("from_s", pa.float64()), ("to_s", pa.float64())]))
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])
#: row: the document's place in its batch of the media file, to which the batch of clips answers.
CLIPS = pa.schema([("row", pa.int32()), ("doc_id", pa.int64()), ("clip", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("segments", SPANS), ("mel", pa.fixed_shape_tensor(pa.float16(), (CLIP, BANDS)))])
ROWS, MOST_BYTES = 256, 4 << 20
STORED = pa.ipc.IpcWriteOptions(compression="zstd")


class _File:
    """An Arrow file that gets its name when it is complete."""

    def __init__(self, folder: str, name: str, schema: pa.Schema):
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        self.name, self.own = f"{base}/{name}", f"{base}/{name}.attempt-{uuid.uuid4().hex}"
        self.files, self.sink = files, files.open_output_stream(self.own)
        self.stream = pa.ipc.new_file(self.sink, schema, options=STORED)

    def close(self) -> str:
        self.stream.close()
        self.sink.close()
        self.files.move(self.own, self.name)
        return self.name


def write_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store each document's payload as a WAV file; one row for each Arrow file: folder, media_path, docs."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, docs = None, 0
        for batch in slices(batches, ROWS, "text", MOST_BYTES):
            out = out or _File(folder, f"part-{TaskContext.get().partitionId():05d}.media.arrow", MEDIA)
            raw = [payload(t) for t in batch.column("text").to_pylist()]
            out.stream.write_batch(pa.record_batch([batch.column("doc_id"), pa.array([n for _, n in raw], pa.int64()), pa.array([to_wav(x) for x, _ in raw], pa.large_binary())], schema=MEDIA))
            docs += batch.num_rows
        if out:
            yield pa.record_batch([pa.array([folder]), pa.array([out.close()]), pa.array([docs], pa.int64())], names=["folder", "media_path", "docs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialise(rows.mapInArrow(write, "folder string, media_path string, docs long"), "media")


def _features(stored: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in CLIPS.names]
    for row, (doc_id, media) in enumerate(zip(stored.column("doc_id").to_pylist(), stored.column("media"), strict=True)):
        _, mel, spans, step = analyse(media.as_buffer().to_pybytes())
        parts = in_clips(mel)
        begins, ends = (np.array([x[k] for x in spans]) for k in (0, 1))
        for k, part in enumerate(parts):
            start, frames = k * CLIP * step, min(CLIP, len(mel) - k * CLIP)
            touching = range(np.searchsorted(ends, start, side="right"), np.searchsorted(begins, start + CLIP * step)) if spans else ()
            for c, v in zip(columns, (row, doc_id, k, frames, start, start + frames * step, [{"from_s": spans[i][0], "to_s": spans[i][1]} for i in touching], part), strict=True):
                c.append(v)
    flat = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(columns[-1]).ravel()), CLIP * BANDS)
    return pa.record_batch([*(pa.array(c, f.type) for c, f in zip(columns[:-1], CLIPS, strict=False)), pa.ExtensionArray.from_storage(CLIPS.field("mel").type, flat)], schema=CLIPS)


def write_clips(media: DataFrame) -> DataFrame:
    """Read stored WAV files and store the clips of log-mel frames with their time spans and segments; media's rows with clips_path."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = file_system(row["folder"])
                out = _File(row["folder"], row["media_path"].rsplit("/", 1)[1].replace(".media.", ".clips."), CLIPS)
                with files.open_input_file(row["media_path"]) as source:
                    stored = pa.ipc.open_file(source)
                    for i in range(stored.num_record_batches):
                        out.stream.write_batch(_features(stored.get_batch(i)))
                yield pa.record_batch([pa.array([row["folder"]]), pa.array([row["media_path"]]), pa.array([out.close()]), pa.array([row["docs"]], pa.int64())], names=["folder", "media_path", "clips_path", "docs"])

    return materialise(each_in_a_task(media).mapInArrow(write, "folder string, media_path string, clips_path string, docs long"), "clips")


def clips(stored: DataFrame) -> DataFrame:
    """Per clip, from the files of ``write_clips``: doc_id, clip, frames, start_s, end_s, segments that touch it, mel (CLIP * BANDS values)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = file_system(row["folder"])
                with files.open_input_file(row["clips_path"]) as source:
                    file = pa.ipc.open_file(source)
                    for i in range(file.num_record_batches):
                        b = file.get_batch(i)
                        mel = b.column("mel").storage.flatten().to_numpy().astype(np.float32)
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (CLIP * BANDS)), pa.array(mel))
                        yield pa.record_batch([*(b.column(c) for c in CLIPS.names[1:-1]), lists], names=CLIPS.names[1:])

    return each_in_a_task(stored).mapInArrow(read, "doc_id long, clip int, frames int, start_s double, end_s double, segments array<struct<from_s: double, to_s: double>>, mel array<float>")


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(stored: pa.RecordBatch, found: pa.RecordBatch) -> pa.RecordBatch:
    """One row a document of a batch of stored media, with the batch of its clips."""
    of, frames = found.column("row").to_numpy(), found.column("frames").to_numpy()
    mel = found.column("mel").storage.flatten().to_numpy().reshape(len(of), CLIP, BANDS)
    bounds = np.searchsorted(of, np.arange(stored.num_rows + 1))
    rows = []
    for i, (doc_id, n, media) in enumerate(zip(stored.column("doc_id").to_pylist(), stored.column("n_bytes").to_pylist(), stored.column("media"), strict=True)):
        media = media.as_buffer().to_pybytes()
        samples, _ = from_wav(media)
        own = range(bounds[i], bounds[i + 1])
        spans = sorted({(x["from_s"], x["to_s"]) for k in own for x in found.column("segments")[k].as_py()})
        real = np.concatenate([mel[k, : frames[k]] for k in own])
        rows.append((doc_id, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), summary(real, spans)))
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)], schema=DIGEST)


def read_digests(stored: DataFrame) -> DataFrame:
    """Per document, from the files of ``write_clips``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, _ = file_system(row["folder"])
                with files.open_input_file(row["media_path"]) as one, files.open_input_file(row["clips_path"]) as other:
                    media, found = pa.ipc.open_file(one), pa.ipc.open_file(other)
                    for i in range(media.num_record_batches):
                        yield _digest(media.get_batch(i), found.get_batch(i))

    return each_in_a_task(stored).mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """Store media and clips of ``docs``, and per document, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    return read_digests(write_clips(write_media(docs)))
