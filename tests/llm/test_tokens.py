"""Operators 4 and 8 against the library's own encoding of whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tallymill.llm import arrow_output, packing
from tallymill.llm.token_ids import WordEncoder
from tokenizers import Tokenizer

from .conftest import SF

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_whole_texts(spark, odd_docs):
    texts = [r["text"] for r in odd_docs.collect()] + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["á ́b", "ΟΔΟΣ Σ", " x　y\x85z", "<|startoftext|><|endoftext|> a<|endoftext|>b", "İstanbul", "e\x1d'll 've", "I'Ll x''s 's_t a_b1½²ªº don'T ©®" , "<|EndOfText|> <|x", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(33, 0x250))), "a" + "a".join(map(chr, range(33, 0x250)))]
    coded = WordEncoder(PATH, remembered=50)
    for at in range(0, len(texts), 40):
        ids, sizes = coded.encode(texts[at : at + 40], 1)
        for text, own in zip(texts[at : at + 40], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == library_ids(text)


def check_pieces(rows, docs, length=2048):
    by_id = {}
    for r in docs:
        by_id.setdefault(r["doc_id"], []).append(library_ids(r["text"]))
    sequences = {}
    for r in rows:
        assert any(len(x) == r["doc_tokens"] and crc(x[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"] for x in by_id[r["doc_id"]])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in rows) == sum(len(x) for xs in by_id.values() for x in xs)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, own in sequences.items():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == length or k == len(sequences) - 1 and at <= length


def test_pieces_tile_documents_and_sequences(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = packing.pack(docs, PATH).collect()
        check_pieces(rows, docs.collect())
    spans = {}
    for r in rows:
        spans.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for own in spans.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), sorted(own)[1:], strict=False))


def test_every_window_has_the_target_proportions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, PATH).toPandas()
    share = rows.groupby("source").length.sum() / rows.length.sum()
    full = rows[rows.sequence_id < rows.sequence_id.max()]
    got = full.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    assert (got - share * 2048).abs().max().max() <= 2 * len(share) + 1


def test_more_sources_than_queues(spark, make_docs):
    docs = make_docs([(i, "word " * (i % 50), "en", None if i % 23 == 7 else f"s{i % 23}") for i in range(300)])
    for fan in (2, 5, 22, 23, 64):
        check_pieces(packing.pack(docs, PATH, length=64, fan=fan).collect(), docs.collect(), 64)


def test_two_hundred_sources_keep_their_shares(spark, make_docs):
    docs = make_docs([(i, "word " * 900, "en", f"s{i % 200}") for i in range(400)] + [(1000 + i, "word " * 3000, "en", "s0") for i in range(30)])
    rows = packing.pack(docs, PATH).toPandas()
    check_pieces([r for r in rows.to_dict("records")], docs.collect())
    share = rows.groupby("source").length.sum() / rows.length.sum()
    full = rows[rows.sequence_id < rows.sequence_id.max() - 8]
    got = full.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    assert (got["s0"] - share["s0"] * 2048).abs().max() <= 2 * 64 + 1  # at the root, where windows begin within a round
    own = sorted(share.drop("s0").index, key=lambda s: (-share[s], s))[:62]
    assert (got[own] - share[own] * 2048).abs().max().max() <= 10
    deep = [s for s in share.index if s != "s0" and s not in own]
    assert (got[deep].sum(axis=1) - share[deep].sum() * 2048).abs().max() <= 2 * 64 + 1
    whole = len(got) // 8 * 8
    eight = got[deep].iloc[:whole].groupby(np.arange(whole) // 8).sum()  # inner rounds are longer than a window
    assert (eight - share[deep] * 2048 * 8).abs().max().max() <= 4096 * share[deep].max() / share[deep].sum() + 64


def test_products_beyond_64_bits():
    a = np.array([0, 1, 10**10, 3 * 10**10 - 1])
    b, c = 2048 * 7 * 10**12 + 1, 6 * 10**13 + 7
    assert packing.muldiv(a, b, c).tolist() == [int(x) * b // c for x in a.tolist()]


def test_files_give_back_every_document(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        manifest = arrow_output.write(docs, PATH, length=128)
        rows = sorted(arrow_output.read(manifest).collect(), key=lambda r: r["start"])
        want = sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, (r["text"] or "").encode()))
        at = 0
        for r, d in zip(rows, want, strict=True):
            ids = library_ids(d["text"])
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), crc(ids))
            at += len(ids)
        for m in manifest.collect():
            _, path = arrow_output.file_system(m["tokens_path"])
            with pa.memory_map(path) as source:  # any sequence without copying
                batches = pa.ipc.open_stream(source).read_all()
                assert batches.num_rows == m["sequences"] and batches.schema.field("ids").type.list_size == 128
                assert sum(map(sum, batches.column("mask").to_pylist())) == m["tokens"]


def test_empty_tables_and_clashing_names(spark, odd_docs):
    assert packing.pack(odd_docs.limit(0), PATH).collect() == []
    assert arrow_output.read(arrow_output.write(odd_docs.limit(0), PATH)).collect() == []
    clash = odd_docs.withColumns({c: F.lit(1) for c in ("part", "ids", "start", "first", "queue", "width")})
    assert arrow_output.read(arrow_output.write(clash, PATH)).count() == odd_docs.count()
    check_pieces(packing.pack(clash, PATH).collect(), odd_docs.collect())
