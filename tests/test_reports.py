"""Closed schemas, the dashboard's one pass, corpora that check themselves, gaps of findings."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallymill.functions import closed
from tallymill.operators import evaluation
from tallymill.plans import catalog
from tallymill.plans.reports import RECORD

SF = "/root/testdata/sf0.001"


def test_closed_schema(spark):
    line = {"description": "a", "amount": 1}
    good = {"vendor": "x", "total": 1.5, "line_items": []}
    cases = {
        "good": (json.dumps(good), []),
        "nulls": (json.dumps(good | {"issue_date": None, "vendor": None}), [("vendor", closed.WANTED["string"])]),
        "lines": (json.dumps(good | {"line_items": [line, line | {"amount": "1"}, None, [], {"x y": 1}]}), [("line_items.1.amount", closed.WANTED["number"]), ("line_items.2", closed.WANTED["object"]), ("line_items.3", closed.WANTED["object"]), ("line_items.4.amount", closed.MISSING), ("line_items.4.x y", closed.SPARE)]),
        "empty": ("{}", [(c, closed.MISSING) for c in ("vendor", "total", "line_items")]),
        "array": ("[1]", [("", closed.WANTED["object"])]), "word": ('"x"', [("", closed.WANTED["object"])]), "null": ("null", [("", closed.WANTED["object"])]),
        "broken": ('{"vendor": ', [("", closed.NO_JSON)]), "none": (None, [("", closed.NO_JSON)]), "blank": ("", [("", closed.NO_JSON)]),
        "big": (json.dumps(good | {"total": 10**30, "line_items": [line] * 400 + [{}]}), [("line_items.400.amount", closed.MISSING)]),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "name string, json string")
    errors = closed.schema_errors(F.col("json"), RECORD)
    for r in df.select("name", errors.alias("errors"), closed.errors_text(errors).alias("text")).collect():
        want = cases[r["name"]][1]
        assert [tuple(e) for e in r["errors"]] == want, r["name"]
        assert r["text"] == (closed.HEADING + "".join(f"\n- `{p or '(root)'}`: {m}" for p, m in want[:6]) if want else None)
    flags = T.StructType([T.StructField("ok", T.BooleanType(), False), T.StructField("inner", T.StructType([T.StructField("n", T.LongType(), False)]))])
    found = spark.range(1).select(closed.schema_errors(F.lit('{"ok": 1, "inner": {"n": true, "m": null}}'), flags)).first()[0]
    assert [e["path"] for e in found] == ["ok", "inner.n", "inner.m"]


def test_dashboard_reads_once(spark):
    found = catalog.QUERIES["dashboard"](spark, SF)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert {r["section"] for r in rows} == {"status", "ended", "vendor", "vendor_currency"}
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2  # orders and customers, once each
    assert final.count("WindowGroupLimit") >= 2  # the largest vendors are cut before they meet


def test_corpora_check_themselves(spark):
    rows = catalog.QUERIES["corpus_self_check"](spark, SF).collect()
    corpora = {r["corpus"] for r in rows}
    assert len(rows) == 10 * len(corpora)
    assert any(r["violations"] for r in rows) and any(r["chosen"] for r in rows)
    for c in corpora:
        passing = sorted(r["seed"] for r in rows if r["corpus"] == c and r["violations"] == 0)
        assert [r["seed"] for r in rows if r["corpus"] == c and r["chosen"]] == passing[:1]


def test_gaps_of_findings(spark):
    rows = [(1, "HIGH", 1.0, "r", '{"a": 1}'), (2, "high", None, " ", "{}"), (3, None, float("nan"), None, None), (4, "CRITICAL", 0.0, "r", "[1]"), (5, "LOW", 0.0, "r", "{")]
    found = {r["id"]: r["gaps"] for r in evaluation.unexplained(spark.createDataFrame(rows, "id int, severity string, score double, reason string, evidence string")).collect()}
    assert found == {2: ["severity", "score", "reason", "evidence"], 3: ["severity", "score", "reason", "evidence"], 4: ["evidence"], 5: ["evidence"]}
