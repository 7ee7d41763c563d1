"""The pipeline's stages, each against a plain version of its rule over its own input."""

import corpus_pipeline
from pyspark.sql import functions as F
from tallymill.llm import language_id, mixing, quality

from .conftest import SF
from .test_near_text import all_pairs
from .test_tokens import check_pieces



def test_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == columns
        assert docs.count() > 0
    after = dict(zip(inputs, [*list(inputs.values())[1:], docs], strict=True))
    rows = {k: {r["doc_id"] for r in v.collect()} for k, v in inputs.items()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    good = {r["doc_id"] for r in quality.classify(inputs["quality"], labels).where("predicted = 1").collect()}
    assert rows["language"] == good
    kept = labels.join(after["quality"], "doc_id").agg(F.avg("quality")).first()[0]
    clean = labels.where("quality = 1 and doc_id is not null")
    assert kept > 0.95 and clean.join(after["quality"], "doc_id", "left_anti").count() <= 0.03 * clean.count()

    told = {r["doc_id"] for r in language_id.language_id(inputs["language"]).where("lang_pred <> 'und'").collect()}
    assert rows["copies"] <= told and len(rows["copies"]) > 0.98 * len(told)

    want = all_pairs([(r["doc_id"], r["text"]) for r in inputs["copies"].collect()])
    assert rows["mixing"] == {i for i, (_, c) in want.items() if i == c}

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(inputs["mixing"]).collect()}
    words = {}
    for r in after["mixing"].collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}

    check_pieces(docs.collect(), inputs["packing"].collect())


def test_run_is_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns[:4] == ["doc_id", "start", "length", "ids_crc32"] and found.count() > 0


def test_stages_take_odd_documents(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out if out.columns == docs.columns else docs
