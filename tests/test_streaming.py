"""Streams give what batches give."""

import time
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from tallymill.operators import screening
from tallymill.streaming import ledger, sinks
from tallymill.streaming import screening as screening_stream

from .test_ledger import INVOICE, many


def drain(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query


def run_until(spark, stream, name, tmp_path, rows):
    """Queries with timers have no end of their own."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        end = time.time() + 200
        while spark.table(name).count() < rows and time.time() < end and query.isActive:
            time.sleep(0.5)
        time.sleep(2)  # nothing more may come
        assert query.exception() is None
        return spark.table(name).collect()
    finally:
        query.stop()


def test_first_of_each_content(spark, tmp_path):
    rows = [(i, f"text {i % 7}") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = ledger.first_of_each(ledger.arrivals(spark, str(tmp_path / "in"), batch.schema))
    drain(stream, "firsts", tmp_path)
    found = spark.table("firsts")
    assert found.count() == 7
    assert {r["text"] for r in found.collect()} == {t for _, t in rows}


def test_rates(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 3).alias("client"))
    events.write.parquet(str(tmp_path / "in"))
    drain(ledger.request_rates(ledger.arrivals(spark, str(tmp_path / "in"), events.schema), "1 hour"), "rates", tmp_path, "complete")
    want = {tuple(r) for r in events.groupBy(F.window("ts", "1 hour"), "client").count().select("window.start", "client", "count").collect()}
    assert {tuple(r) for r in spark.table("rates").collect()} == want


@pytest.fixture
def store(spark):
    for k, v in screening_stream.STORE.items():
        spark.conf.set(k, v)
    yield
    for k in screening_stream.STORE:
        spark.conf.unset(k)


def files_of(spark, folder, rows, schema, parts):
    """One file for each part, written one after the other."""
    for k, part in enumerate(parts):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1 if k + 1 < len(parts) else 0)  # a file source takes files by their times


REQUESTS = "document_id long, seq long, wanted string"


@pytest.mark.parametrize("parts", [[[0, 1, 2, 3, 4, 5, 6, 7, 8]], [[1, 8, 4], [0, 2, 3, 6], [5, 7, 0, 1, 2]]])
def test_state_machine(spark, tmp_path, store, parts):
    """Replayed and shuffled requests give one row a change."""
    rows = [(1, 1, "PROCESSING"), (1, 2, "DONE"), (1, 3, "FAILED"), (2, 1, "DONE"), (2, 2, "FAILED"), (3, 1, "PROCESSING"), (3, 2, "PROCESSING"), (3, 3, "NEEDS_REVIEW"), (2, 3, "PROCESSING")]
    files_of(spark, str(tmp_path / "in"), rows, REQUESTS, parts)
    name = f"turns{len(parts)}"
    stream = ledger.state_machine(ledger.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], REQUESTS).schema))
    found = [(r["document_id"], r["was"], r["status"]) for r in run_until(spark, stream, name, tmp_path, 5)]
    assert sorted(found) == [(1, "PENDING", "PROCESSING"), (1, "PROCESSING", "DONE"), (2, "PENDING", "FAILED"), (3, "PENDING", "PROCESSING"), (3, "PROCESSING", "NEEDS_REVIEW")]


def test_lost_documents_fail(spark, tmp_path, store):
    rows = [(1, 1, "PROCESSING"), (2, 1, "FAILED"), (9, 1, "PROCESSING"), (9, 2, "DONE"), (1, 2, "DONE")]
    files_of(spark, str(tmp_path / "in"), rows, REQUESTS, [[0, 1, 2, 3]])
    stream = ledger.state_machine(ledger.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], REQUESTS).schema), lost_ms=1)
    found = sorted((r["document_id"], r["was"], r["status"], r["error_code"]) for r in run_until(spark, stream, "lost", tmp_path, 5))
    assert found == [(1, "PENDING", "PROCESSING", None), (1, "PROCESSING", "FAILED", "worker_lost"), (2, "PENDING", "FAILED", None), (9, "PENDING", "PROCESSING", None), (9, "PROCESSING", "DONE", None)]


def test_screening_at_arrival(spark, tmp_path, store):
    """Three batches with a restart after the first find what one batch over all finds."""
    rows = [*many(), *((1000 + i, f"z{i:02}", "Steady Works", date(2026, 1, 1) + timedelta(days=20 * i), Decimal(1000 + i % 7 + (8000 if i % 13 == 12 else 0)), "AED", "Net 60" if i % 11 == 10 else "Net 30") for i in range(40))]
    n = len(rows)
    tables = sinks.Ledger(spark, str(tmp_path / "ledger"), screening_stream.LEDGER)
    for part in (range(n // 3), range(n // 3, n)):
        cut = [part] if part.start == 0 else [range(part.start, part.start + len(part) // 2), range(part.start + len(part) // 2, n)]
        files_of(spark, str(tmp_path / "in"), rows, INVOICE, cut)
        stream = ledger.arrivals(spark, str(tmp_path / "in"), spark.createDataFrame([], INVOICE).schema)
        screening_stream.screen_arrivals(stream, tables, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(300)
    columns = ["document_id", "anomaly_type", "severity", "score", "fingerprint", "reason", "evidence"]
    want = {tuple(r) for r in screening.screen(spark.createDataFrame(rows, INVOICE)).select(columns).collect()}
    found = [tuple(r) for r in tables.read("findings").select(columns).collect()]
    assert set(found) == want and len(found) == len(want)
    assert {"duplicate", "amount_zscore", "term_drift", "round_number"} <= {r[1] for r in want}
    assert tables.read("invoices").count() == n and tables.committed().count() == 3


def test_replayed_batches_change_nothing(spark, tmp_path):
    schemas = {"documents": "file_hash string, seq long", "audit": "event string", "traces": "cost double", "dead": "reason string"}
    tables = sinks.Ledger(spark, str(tmp_path / "ledger"), schemas)
    one = {"documents": spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "file_hash string, seq long"), "audit": spark.createDataFrame([("x",), ("x",)], "event string")}
    two = {"documents": spark.createDataFrame([("b", 4), ("c", 5)], "file_hash string, seq long"), "dead": spark.createDataFrame([("r",)], "reason string"), "traces": spark.createDataFrame([(0.5,)], "cost double")}
    assert tables.commit(0, one) and not tables.commit(0, one)
    # a batch that fails before it is recorded is not seen, and is written anew
    broken = {"documents": two["documents"], "dead": two["dead"].select(F.raise_error(F.lit("lost")).cast("string").alias("reason"))}
    with pytest.raises(Exception, match="lost"):
        tables.commit(1, broken)
    assert sorted(r["file_hash"] for r in tables.read("documents").collect()) == ["a", "b"]
    for _ in range(3):
        tables.commit(1, two)
    assert sorted(r["file_hash"] for r in tables.read("documents").collect()) == ["a", "b", "c"]
    assert [tables.read(n).count() for n in ("audit", "traces", "dead")] == [2, 1, 1]
