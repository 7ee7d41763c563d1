"""Operator 9: language ID by a bidirectional gated recurrent network over UTF-8 bytes, trained in numpy by backpropagation through time.

A text is cut into windows of ``WINDOW`` bytes, its last one shorter. One network reads each window forwards, another
backwards; at every byte both states give the probabilities of the languages. A document's probabilities
are the mean over all its bytes. Nothing of a text is left out.

Learning: from documents that aren't held out and whose lang isn't null: of each language some ``SAMPLE`` distinct texts
(fewer if there are more than ``MANY`` languages) by their hash (a bound on the sample, not on what is labelled), of each a span of at most ``SPAN`` characters at a place the hash
gives, windows of all languages alike often. The weights are the same at every run over the same rows.

Cases: lang_pred is "und", score 0, if a text is null or has no letter, or if there is nothing to learn from.
Memory is bounded however many languages there are (``HELD``) and however long a text is.
Repeated rows get equal labels. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import broadcast_if_small, held_out, materialise, slices, small_batches, text_bytes

WINDOW = 96
HIDDEN = 12
SAMPLE = 1200
SPAN = 480
#: With more languages than these each has a smaller sample, of LEAST texts at least; no language is left out.
MANY, LEAST = 64, 120
SHARES = 1 << 20
#: Windows times languages whose probabilities are held at once: with many languages fewer windows run in step.
HELD = 1 << 16


class ByteGru:
    """Two gated recurrent networks over bytes, one in each direction, and a common layer of labels.

    ``x`` has a byte's share in the gates (update, reset, candidate), direction first; ``u`` that of the state.
    Gates are 1/2 + tanh/2, their halving being in the weights.
    """

    def __init__(self, labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.labels = h, labels
        self.p = {
            "x": (rng.standard_normal((2, 257, 3 * h)) * 0.3).astype(np.float32),
            "u": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "v": (rng.standard_normal((2, h, labels)) / np.sqrt(h)).astype(np.float32),
            "c": np.zeros(labels, np.float32),
        }
        self.p["x"][:, :, :h] += 0.5

    def _inputs(self, windows: np.ndarray) -> np.ndarray:
        """Bytes as the two networks meet them, time first; 256 stands for no byte."""
        return np.stack([windows.T, windows[:, ::-1].T], axis=1)

    def run(self, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
        """Logits of each place: (time, windows, labels). windows: int (windows, time), 256 behind the end of a text.

        Where there is no byte, a network's state stays as it is, so the backward one starts at a text's last byte.
        """
        x, u, v = self.p["x"], self.p["u"], self.p["v"]
        n, steps = windows.shape
        h = self.hidden
        seen = self._inputs(windows)
        state = np.zeros((2, n, h), np.float32)
        logits = np.empty((2, steps, n, self.labels), np.float32)
        ragged = (windows == 256).any()
        both = np.arange(2)[:, None]
        for t in range(steps):
            byte = seen[t]
            g = x[both, byte]
            s = np.matmul(state, u)
            gates = g[..., : 2 * h] + s[..., : 2 * h]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[..., :h], gates[..., h:]
            sn = s[..., 2 * h :]
            new = r * sn
            new += g[..., 2 * h :]
            np.tanh(new, out=new)
            before = state
            state = before - new
            state *= z
            state += new
            if ragged:
                state = np.where((byte == 256)[..., None], before, state)
            if trace is not None:
                trace.append((byte, before, z, r, sn, new, state))
            out = np.matmul(state, v)
            logits[0, t] = out[0]
            logits[1, steps - 1 - t] = out[1]
        return logits[0] + logits[1] + self.p["c"]

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Sums over each window's bytes of the labels' probabilities."""
        out = self.run(windows)
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        if (windows == 256).any():
            out *= (windows.T != 256)[..., None]
        return out.sum(axis=0)

    def lanes(self, most: int) -> int:
        """Of ``most`` windows, how many run in step."""
        return max(1, min(most, HELD // self.labels))

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over places, and its gradients, gathered over as many windows at a time as ``lanes`` says."""
        places = max(1, int((windows != 256).sum()))
        step = self.lanes(len(windows))
        loss, grad = self._gradients(windows[:step], label[:step], places)
        for at in range(step, len(windows), step):
            more, further = self._gradients(windows[at : at + step], label[at : at + step], places)
            loss += more
            for k, g in further.items():
                grad[k] += g
        return loss, grad

    def _gradients(self, windows: np.ndarray, label: np.ndarray, places: int) -> tuple[float, dict[str, np.ndarray]]:
        """Loss over places, divided by ``places``, and its gradients by backpropagation through time."""
        h = self.hidden
        trace: list = []
        out = self.run(windows, trace)
        steps, n, _ = out.shape
        real = (windows.T != 256)[..., None]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        loss = -float((np.log(out[:, np.arange(n), label] + 1e-9) * real[..., 0]).sum()) / places
        out[:, np.arange(n), label] -= 1
        out *= real / places
        grad = {k: np.zeros_like(w) for k, w in self.p.items()}
        grad["c"] = out.sum(axis=(0, 1))
        u, v = self.p["u"], self.p["v"]
        back = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            byte, before, z, r, sn, new, state = trace[t]
            d_out = np.stack([out[t], out[steps - 1 - t]])
            grad["v"] += np.matmul(state.transpose(0, 2, 1), d_out)
            d = back + np.matmul(d_out, v.transpose(0, 2, 1))
            held = (byte == 256)[..., None]
            kept = np.where(held, d, 0)
            d = np.where(held, 0, d)
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (before - new) * (2 * z * (1 - z))
            d_r = d_new * sn * (2 * r * (1 - r))
            d_s = np.concatenate([d_z, d_r, d_new * r], axis=2)
            d_g = np.concatenate([d_z, d_r, d_new], axis=2)
            grad["u"] += np.matmul(before.transpose(0, 2, 1), d_s)
            for k in range(2):
                one = np.zeros((257, n), np.float32)
                one[byte[k], np.arange(n)] = 1
                grad["x"][k] += one @ d_g[k]
            back = kept + d * z + np.matmul(d_s, u.transpose(0, 2, 1))
        return loss, grad

    def fit(self, windows: np.ndarray, label: np.ndarray, steps: int = 260, batch: int = 256, rate: float = 0.02, seed: int = 11) -> float:
        """Adam over batches with all labels alike often; the last losses' mean."""
        rng = np.random.default_rng(seed)
        groups = [np.flatnonzero(label == k) for k in range(self.labels)]
        groups = [g for g in groups if len(g)]
        m, s = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(g, max(2, batch // len(groups))) for g in groups])
            loss, grad = self.gradients(windows[pick], label[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            now = rate * min(1.0, 3 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.p[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses[-20:]))


def window_places(offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of ``window`` bytes that texts are cut into: the text of each, where it begins, and its length."""
    sizes = np.diff(offsets)
    rows = -(-sizes // window)
    of = np.repeat(np.arange(len(sizes)), rows)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = offsets[of] + nth * window
    return of, start, np.minimum(window, offsets[of + 1] - start)


def windows_at(data: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Rows of ``window`` bytes, 256 behind ``length``."""
    place = np.arange(window)
    out = data[np.minimum(start[:, None] + place, max(len(data) - 1, 0))].astype(np.int16)
    out[place >= length[:, None]] = 256
    return out


def sample(docs: DataFrame, per_language: int = SAMPLE, span: int = SPAN) -> DataFrame | None:
    """Rows (lang, text: part of a text) to learn from, about ``per_language`` distinct texts of each language at most, and at least that with the least hash."""
    hashed = F.xxhash64("text")
    learn = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", hashed.alias("hash"), F.pmod(hashed, F.lit(SHARES)).alias("nth"))
    texts = learn.select("lang", "hash", "nth").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.min("nth").alias("least"))
    texts = materialise(texts, "languages")
    n = texts.count()
    if not n:
        return None
    each = min(per_language, max(LEAST, per_language * MANY // n))
    share = F.greatest(F.least(F.lit(SHARES), F.floor(F.lit(SHARES * each) / F.col("texts")) + 1), F.col("least") + 1)
    shares = broadcast_if_small(texts.select("lang", share.alias("share")))
    place = 1 + F.pmod(F.shiftright("hash", 20), F.greatest(F.length("text") - span, F.lit(1)))
    rows = learn.join(shares, "lang").where("nth < share").select("lang", F.substring("text", place.cast("int"), F.lit(span)).alias("text"))
    return rows.distinct()  # copies of one text, however many, are one row


def fit(rows: list[tuple[str, str]], window: int = WINDOW, hidden: int = HIDDEN, steps: int = 260) -> tuple[list[str], ByteGru]:
    """The languages of rows (lang, text), by code point, and a network that tells them; the same whatever the rows' order."""
    rows = sorted(rows)
    languages = sorted({r[0] for r in rows})
    raw = [t.encode() for _, t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    of, start, length = window_places(offsets, window)
    windows = windows_at(np.frombuffer(b"".join(raw), np.uint8), start, length, window)
    number = {lang: k for k, lang in enumerate(languages)}
    label = np.array([number[rows[i][0]] for i in of.tolist()])
    model = ByteGru(len(languages), hidden)
    if len(languages) > 1 and len(windows):
        model.fit(windows, label, steps)
    return languages, model


def train(docs: DataFrame, window: int = WINDOW, hidden: int = HIDDEN, steps: int = 260) -> tuple[list[str], ByteGru | None]:
    """Learn from the sample of ``docs``, which is bounded, in one task: workers, unlike drivers, give numpy one thread, which such small products want."""
    rows = sample(docs)
    if rows is None:
        return [], None

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
        if held:
            yield pa.record_batch([pa.array([pickle.dumps(fit(held, window, hidden, steps))], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else ([], None)


#: Windows that run in step; enough to make numpy's own work small, little enough for a core's cache.
LANES = 1536


def predict(languages: list[str], model: ByteGru, text: pa.Array, window: int = WINDOW, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its language and its probability."""
    data, offsets = text_bytes(text)
    of, start, length = window_places(offsets, window)
    total = np.zeros((len(offsets) - 1, len(languages)))
    lanes = model.lanes(lanes)
    for rows in (np.flatnonzero(length == window), np.flatnonzero(length < window)):
        for at in range(0, len(rows), lanes):
            pick = rows[at : at + lanes]
            np.add.at(total, of[pick], model.probabilities(windows_at(data, start[pick], length[pick], window)))
    total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
    return total.argmax(axis=1), np.minimum(total.max(axis=1, initial=0), 1)


def identify(docs: DataFrame, languages: list[str], model: ByteGru | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    small_batches(docs.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "text"):
            if batch.num_rows:
                best, score = predict(languages, model, batch.column("text"))
                yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), batch.column("lettered"), pa.array(languages).take(pa.array(best)), pa.array(score)], names=["doc_id", "held_out", "lettered", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"), "text")
    if not languages:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    found = rows.mapInArrow(label, "doc_id long, held_out boolean, lettered boolean, lang_pred string, score double")
    return found.select("doc_id", "held_out", F.when(F.col("lettered"), F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from ``docs`` and label all of them: doc_id, held_out, lang_pred, score."""
    return identify(docs, *train(docs))


def known(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """The documents, with all their columns, whose language is told: not "und" and with a probability of ``least``."""
    languages, model = train(docs)
    if not languages:
        return docs.limit(0)
    small_batches(docs.sparkSession)
    kept = docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512, "text"):
            if batch.num_rows:
                _, score = predict(languages, model, batch.column("text"))
                yield batch.filter(pa.array(score >= least))

    lettered = docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return lettered.mapInArrow(keep, docs.schema).select(*kept)
