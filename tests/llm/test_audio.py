"""Operator 7: exact round trips, and features against their definitions."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tallymill.llm import audio


def test_round_trip(odd_docs):
    rows = {}
    for r in audio.digests(odd_docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    docs = odd_docs.collect()
    assert sum(map(len, rows.values())) == len(docs)
    for d in docs:
        raw = (d["text"] or "").encode()
        padded = raw + b"\0" * ((-len(raw)) % 64 if raw else 64)
        r = next(x for x in rows[d["doc_id"]] if x["payload_sha256"] == hashlib.sha256(padded).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"], r["media_bytes"]) == (len(raw), len(padded), zlib.crc32(padded[-64:]), len(padded) + 44)
        assert r["media_sha256"] == hashlib.sha256(audio.to_wav(padded)).hexdigest()
    same = rows[4]
    assert len({x["feature"] for x in same if x["n_bytes"] == 28}) == 1


def test_any_bytes_are_stored_losslessly():
    samples = bytes(range(256)) * 2
    assert audio.from_wav(audio.to_wav(samples)) == (samples, audio.RATE)


def test_polyphase_is_filtering_between_zeros():
    x = np.random.default_rng(0).standard_normal(501)
    for up, down in ((5, 8), (1, 2), (3, 1), (4, 6), (1, 1)):
        stuffed = np.zeros(len(x) * up)
        stuffed[::up] = x
        direct = np.convolve(stuffed, audio.phases(up, down, 8).T.reshape(-1))[: len(stuffed)][::down]
        assert np.allclose(direct, audio.resample(x, up, down, 8))
    assert audio.resample(np.ones(1), 5, 8).shape == (1,)


def test_log_mel_of_a_tone():
    rate, f = 10_000, 1500
    mel, _ = audio.log_mel(np.sin(2 * np.pi * f * np.arange(4000) / rate), rate)
    centre = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 1400), audio.BANDS + 2)[1:-1] / 2595) - 1)
    assert abs(centre[mel.mean(axis=0).argmax()] - f) < 150
    assert len(mel) == -(-(4000 - 256) // 128) + 1


def test_hysteresis_by_a_plain_loop():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 400):
        energy = np.cumsum(rng.standard_normal(n))
        mean, spread, on, want = energy.mean(), energy.std(), False, []
        for i, e in enumerate(energy):
            if spread >= 1e-6 and not on and e > mean + 0.25 * spread:
                on = True
                want.append([i, n])
            elif on and e < mean - 0.25 * spread:
                on = False
                want[-1][1] = i
        assert audio.segments(energy) == [tuple(x) for x in want]


def test_clips_and_files(odd_docs):
    stored = audio.write_clips(audio.write_media(odd_docs.dropDuplicates(["doc_id", "text"])))
    rows = audio.clips(stored).collect()
    files = stored.collect()
    kept = [pa.ipc.open_file(pa.memory_map(f["clips_path"])).read_all() for f in files]
    assert all(t.schema.field("mel").type.shape == [audio.CLIP, audio.BANDS] for t in kept)
    assert sum(t.num_rows for t in kept) == len(rows)
    for r in rows:
        assert len(r["mel"]) == audio.CLIP * audio.BANDS and r["start_s"] < r["end_s"] and 0 < r["frames"] <= audio.CLIP
        assert all(s["from_s"] < r["start_s"] + audio.CLIP * 0.0128 + 1e-9 and s["to_s"] > r["start_s"] for s in r["segments"])
    long = sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["start_s"])
    assert len(long) > 5 and [r["clip"] for r in long] == list(range(len(long)))
    text = next(d["text"] for d in odd_docs.collect() if d["doc_id"] == 5)
    _, mel, spans, _ = audio.analyse(audio.to_wav(audio.payload(text)[0]))
    assert {(s["from_s"], s["to_s"]) for r in long for s in r["segments"]} == set(spans)
    assert np.array_equal(np.concatenate([np.array(r["mel"]).reshape(audio.CLIP, -1)[: r["frames"]] for r in long]), mel.astype(np.float32))


def test_blocks_of_frames_make_no_difference(monkeypatch):
    media = audio.to_wav(audio.payload("some words that go on, and on; " * 3000)[0])
    whole = audio.analyse(media)
    monkeypatch.setattr(audio, "FRAMES_AT_ONCE", 35)
    parts = audio.analyse(media)
    assert np.allclose(whole[1], parts[1], atol=0.02) and len(whole[1]) == len(parts[1])
    assert np.allclose(whole[2], parts[2])


def test_features_are_those_of_the_stored_bytes(odd_docs):
    for r, d in ((r, d) for r in audio.digests(odd_docs.where("doc_id = 7")).collect() for d in odd_docs.where("doc_id = 7").collect()):
        _, mel, spans, _ = audio.analyse(audio.to_wav(audio.payload(d["text"])[0]))
        assert r["feature"] == audio.summary(mel, spans)


def test_empty_and_clashing(odd_docs):
    assert audio.digests(odd_docs.limit(0)).collect() == []
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("media", "mel", "n_bytes", "clip", "folder")})
    assert audio.digests(clash).count() == odd_docs.count()
