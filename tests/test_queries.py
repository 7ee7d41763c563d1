"""Every query of the ledger with SQL against that SQL, on the smallest tables; and files as sources."""

import glob
import os

import duckdb
import pytest
from tallymill.plans import catalog
from tallymill.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    found.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def plain(row):
    return tuple((v is not None, repr(round(v, 6)) if isinstance(v, float) else str(v)) for v in row)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, db, name):
    found = catalog.QUERIES[name](spark, SF)
    want = db.sql(catalog.ORACLES[name])
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(plain(r[c] for c in want.columns) for r in found.collect()) == sorted(map(plain, want.fetchall()))


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_query_without_sql(spark, name):
    catalog.QUERIES[name](spark, SF).count()


def test_vendor_similarity_by_hand(spark):
    from tests.test_functions import ratio

    names = {r["c_custkey"]: r["name"] for r in catalog._vendor_names(spark, SF).collect()}
    rows = {(r["a"], r["b"]): r["ratio"] for r in catalog.QUERIES["vendor_similarity"](spark, SF).collect()}
    want = {(a, b): ratio(names[a], names[b]) for a in names for b in names if a % 20 == 0 and a != b}
    assert set(rows) == {k for k, v in want.items() if v >= 88} and len(rows) > 10
    assert all(abs(v - want[k]) < 1e-3 for k, v in rows.items())


def test_uploads(spark, tmp_path):
    for name, content in {"a.pdf": b"%PDF-1.7 x", "b.txt": b"plain text", "c.png": b"\x89PNG\r\n\x1a\n.." * 9}.items():
        (tmp_path / name).write_bytes(content)
    rows = {r["filename"]: (r["media_type"], r["verdict"]) for r in files.uploads(spark, str(tmp_path), most_bytes=50).collect()}
    assert rows == {"a.pdf": ("application/pdf", None), "b.txt": (None, "unsupported"), "c.png": (None, "too_large")}


def test_manifest(spark, tmp_path):
    (tmp_path / "labels.json").write_text('[{"filename": "a.pdf", "is_scan": false, "expected_anomalies": [], "ground_truth": {"vendor": "X", "due_date": null, "line_items": []}, "more": 1}]')
    r = files.label_manifest(spark, str(tmp_path / "labels.json")).first()
    assert r["ground_truth"]["vendor"] == "X" and r["ground_truth"]["line_items"] == []


def test_missing_files(spark):
    manifest = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("b.pdf",), (None,)], "filename string").where("filename is not null")
    assert [r["filename"] for r in files.missing_files(manifest, spark.createDataFrame([("a.pdf",), ("c.pdf",)], "filename string")).collect()] == ["b.pdf"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "timeout", "r" * 5000), (2, None, None)], "id int, error_code string, reason string")
    failed = files.dead_letters(rows).collect()
    assert [(r["id"], len(r["reason"]), len(r["status_reason"])) for r in failed] == [(1, 4000, 1000)]
    log = str(tmp_path / "log")
    files.append_audit(rows, log)
    files.append_audit(rows, log)
    assert spark.read.parquet(log).count() == 4
    files.replace(rows.limit(1), log)
    assert spark.read.parquet(log).count() == 1
    files.write_report(rows, str(tmp_path / "report"))
    assert sorted(r["id"] for r in spark.read.json(str(tmp_path / "report")).collect()) == [1, 2]


def test_labels_hold_in_any_order(spark):
    from pyspark.sql import functions as F
    from tallymill.operators import evaluation

    rows = spark.createDataFrame([(["a", "b"], ["b", "a", "a"]), ([], []), (["a"], []), ([], ["a"])], "e array<string>, o array<string>")
    assert [r[0] for r in rows.select(evaluation.as_labelled(F.col("e"), F.col("o"))).collect()] == [True, True, False, False]


def test_unreadable_scans_are_counted_only(spark):
    from tallymill.operators import evaluation

    results = spark.createDataFrame([("a", "real", (None,)), ("b", "real", ("X LLC",)), ("c", "generated", (None,)), ("gone", "real", ("Y",))], "filename string, population string, observed struct<vendor: string>")
    manifest = spark.createDataFrame([("a", True, ("X",)), ("b", True, ("x",)), ("c", False, ("Z",))], "filename string, is_scan boolean, expected struct<vendor: string>")
    rows = {r["population"]: tuple(r)[1:] for r in evaluation.population_scores(results, manifest, ["vendor"]).collect()}
    assert rows == {"real": (1, 1, 1, 1, 1.0), "generated": (1, 0, 0, 1, 0.0)}
    online = evaluation.population_scores(results, manifest, ["vendor"], offline=False).where("population = 'real'").first()
    assert (online["documents"], online["unreadable"], online["correct"]) == (2, 0, 1)
