"""Operator 9: held-out accuracy, gradients against differences, windows against the plain recurrence."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallymill.llm import language_id

from .conftest import SF


def test_gradients_by_differences():
    model = language_id.ByteGru(3, 4)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 250, (5, 9))
    windows[1, 6:] = 256
    windows[3, 2:] = 256
    label = np.array([0, 1, 2, 1, 0])

    def loss():
        out = model.run(windows).astype(float)
        out -= np.log(np.exp(out).sum(axis=2, keepdims=True))
        real = windows.T != 256
        return -(out[:, np.arange(5), label] * real).sum() / real.sum()

    _, grad = model.gradients(windows, label)
    for k, g in grad.items():
        for i in np.abs(g).ravel().argsort()[-5:]:
            flat = model.p[k].reshape(-1)
            was = flat[i]
            flat[i] = was + 1e-3
            up = loss()
            flat[i] = was - 1e-3
            assert abs((up - loss()) / 2e-3 - g.ravel()[i]) < 1e-4
            flat[i] = was


def test_many_languages_run_in_fewer_lanes(monkeypatch):
    model = language_id.ByteGru(6, 4)
    rng = np.random.default_rng(1)
    windows, label = rng.integers(0, 250, (11, 9)), rng.integers(0, 6, 11)
    windows[4, 3:] = 256
    loss, grad = model.gradients(windows, label)
    text = pa.array(["".join(chr(rng.integers(97, 123)) for _ in range(k * 37)) for k in range(1, 9)])
    best, score = language_id.predict(list("abcdef"), model, text, 16)
    monkeypatch.setattr(language_id, "HELD", 18)
    assert model.lanes(1536) == 3
    less, parts = model.gradients(windows, label)
    assert abs(less - loss) < 1e-5 and all(np.abs(parts[k] - g).max() < 1e-5 for k, g in grad.items())
    found, again = language_id.predict(list("abcdef"), model, text, 16)
    assert found.tolist() == best.tolist() and np.abs(again - score).max() < 1e-6


def test_states_by_the_plain_recurrence():
    model = language_id.ByteGru(3, 4)
    text = "Grüße!".encode()
    windows = np.full((1, 12), 256)
    windows[0, : len(text)] = list(text)

    def sigmoid(x):  # the halving of gates is in the weights
        return 1 / (1 + np.exp(-2 * x))

    states = []
    for k, run in ((0, text), (1, text[::-1])):
        h, own = np.zeros(4), []
        for b in run:
            x, s = model.p["x"][k, b], h @ model.p["u"][k]
            z, r = sigmoid(x[:4] + s[:4]), sigmoid(x[4:8] + s[4:8])
            new = np.tanh(x[8:] + r * s[8:])
            h = (1 - z) * new + z * h
            own.append(h)
        states.append(own)
    out = model.run(windows)
    for t in range(len(text)):
        want = states[0][t] @ model.p["v"][0] + states[1][len(text) - 1 - t] @ model.p["v"][1] + model.p["c"]
        assert np.allclose(out[t, 0], want, atol=1e-5)


def test_windows_hold_every_byte(odd_docs):
    texts = [r["text"] or "" for r in odd_docs.collect()]
    data, offsets = language_id.text_bytes(pa.array(texts))
    of, start, length = language_id.window_places(offsets, 31)
    windows = language_id.windows_at(data, start, length, 31)
    for i, t in enumerate(texts):
        assert bytes(windows[of == i][windows[of == i] < 256].astype(np.uint8)) == t.encode()


def test_held_out_accuracy_and_repeatability(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = sorted(map(tuple, language_id.language_id(docs).collect()))
    assert all(held == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= s <= 1 for i, held, _, s in rows)
    assert np.mean([p == lang[i] for i, held, p, _ in rows if held]) > 0.9
    changed = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    again = sorted(map(tuple, language_id.language_id(changed).collect()))
    assert [(i, p) for i, _, p, _ in rows] == [(i, p) for i, _, p, _ in again]


def test_odd_rows(spark, odd_docs):
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("held_out", "score", "lettered", "lang_pred")})
    rows = language_id.language_id(clash).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert language_id.language_id(odd_docs.limit(0)).collect() == []
    assert {r["lang_pred"] for r in language_id.language_id(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = language_id.known(odd_docs)
    assert kept.columns == odd_docs.columns


def test_every_language_is_learned(make_docs):
    docs = make_docs([(9 * k + i, f"text {i} of number {k}", f"l{k}", "s") for k in range(70) for i in range(9)])
    assert {r["lang"] for r in language_id.sample(docs).collect()} == {f"l{k}" for k in range(70)}
    assert len(language_id.train(docs, steps=1)[0]) == 70


def test_copies_take_no_place_in_the_sample(make_docs):
    rows = [(i, "one text, copied", "en", "s") for i in range(2000)] + [(2000 + i, f"text {i} of its own", "en", "s") for i in range(300)]
    rows += [(3000 + i, f"this is text {i % 2} of two", "de", "s") for i in range(2000)]
    found = [r["lang"] for r in language_id.sample(make_docs(rows), per_language=20).collect()]
    assert 10 <= found.count("en") <= 40 and found.count("de") == 2
