"""The ledger's tables as closed schemas, and what breaks them: Spark keeps no constraints, so filters do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "id string, file_hash string, filename string, media_type string, size_bytes int, status string, status_reason string, doc_kind string, lane string, page_count int, latency_ms int, cost_usd decimal(12,6), llm_mode string, created_at timestamp, updated_at timestamp",
    "extractions": "id string, document_id string, vendor string, invoice_number string, issue_date date, due_date date, subtotal decimal(14,2), tax decimal(14,2), total decimal(14,2), currency string, payment_terms string, line_items array<struct<description: string, qty: decimal(18,6), unit_price: decimal(18,6), amount: decimal(18,6)>>, is_valid boolean, repair_attempts int, model string, lane string, created_at timestamp",
    "anomalies": "id string, document_id string, anomaly_type string, severity string, reason string, score decimal(10,4), evidence string, fingerprint string, status string, resolved_at timestamp, resolved_note string, created_at timestamp",
    "audit_log": "id bigint, document_id string, event string, stage string, actor string, payload string, created_at timestamp",
    "failed_jobs": "id string, document_id string, file_hash string, stage string, error_code string, reason string, attempts int, context string, created_at timestamp",
    "llm_traces": "document_id string, stage string, purpose string, model string, mode string, input_tokens int, output_tokens int, latency_ms int, attempts int, cost_usd decimal(12,6), created_at timestamp",
}
# The legal values of closed columns.
LEGAL = {
    "documents": {"status": ["PENDING", "PROCESSING", "DONE", "NEEDS_REVIEW", "FAILED"], "doc_kind": ["invoice", "receipt", "contract", "unknown"], "lane": ["text", "vision"]},
    "anomalies": {"anomaly_type": ["duplicate", "amount_zscore", "term_drift", "round_number"], "severity": ["LOW", "MEDIUM", "HIGH"], "status": ["OPEN", "APPROVED", "REJECTED"]},
    "audit_log": {"stage": ["ingest", "route", "extract", "validate", "screen", "ledger"]},
}
#: Longest texts of an extracted record; longer ones are schema errors.
LONGEST = {"vendor": 256, "invoice_number": 128, "payment_terms": 128, "currency": 8}


def illegal(table: str) -> Column:
    """Names of closed columns that hold something else than their legal values; nulls are legal."""
    bad = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(values), c) for c, values in LEGAL.get(table, {}).items()]
    return F.filter(F.array(*bad), lambda c: c.isNotNull()) if bad else F.array().cast("array<string>")


#: Most lines of a record, and the longest description of one.
MOST_LINES, LONGEST_DESCRIPTION = 200, 512


def bounded_lines(lines: Column) -> Column:
    """The first lines that a record may hold, descriptions cut; null is none."""
    kept = F.slice(lines, 1, MOST_LINES)
    cut = lambda x: x.withField("description", F.substring(x["description"], 1, LONGEST_DESCRIPTION))
    # what has no more bytes has no more letters either, and that is known without walking through it
    return F.coalesce(F.transform(kept, lambda x: F.when(F.octet_length(x["description"]) > LONGEST_DESCRIPTION, cut(x)).otherwise(x)), F.array())


def bounded_rows(lines: DataFrame) -> DataFrame:
    """The same of lines that come as rows, numbered from 1 within their record (``line``), with a ``description``; and ``letters``, how many its description keeps. A row without a number stands for a record without lines and stays.

    Letters are walked through only where the bytes that may be kept aren't all ASCII. Read as Latin-1 these grow by one for each other byte, which takes copies and no walk.
    """
    held = lines.where(F.coalesce(F.col("line") <= MOST_LINES, F.lit(True)))
    held = held.withColumn("head_", F.substring(F.col("description").cast("binary"), 1, LONGEST_DESCRIPTION))
    held = held.withColumn("plain_", F.octet_length(F.decode("head_", "ISO-8859-1")) == F.octet_length("head_"))
    held = held.withColumn("description", F.when(F.col("plain_"), F.col("head_").cast("string")).otherwise(F.substring("description", 1, LONGEST_DESCRIPTION)))
    return held.withColumn("letters", F.when(F.col("plain_"), F.octet_length("head_")).otherwise(F.length("description"))).drop("head_", "plain_")


def too_long() -> Column:
    return F.filter(F.array(*(F.when(F.length(c) > n, c) for c, n in LONGEST.items())), lambda c: c.isNotNull())


def unknown_fields(json: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object that a closed schema doesn't know."""
    return F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def differs(df: DataFrame, table: str) -> list[str]:
    """Columns that are missing, spare or of another type than the table's."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(SCHEMAS[table])}
    have = dict(df.dtypes)
    return sorted({c for c in want | have if want.get(c) != have.get(c)})
