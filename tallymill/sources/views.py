"""Ledger tables as views over the star schema: the same names and types as a real ledger's, by selects alone.

Each view has SQL that gives the same rows in DuckDB; ``WITH`` holds them all for use before a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an invoice, ingest_seq being the order of arrival."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    word = F.translate(F.md5(F.col("o_custkey").cast("string").cast("binary")), "0123456789", "ghijklmnop")
    suffix = F.element_at(F.array(*map(F.lit, (" LLC", " L.L.C.", " FZ-LLC", ", Inc.", ""))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    total = F.when(F.col("o_orderkey") % 40 == 0, F.round(F.col("o_totalprice"), -3)).otherwise(F.round(F.col("o_totalprice"), 2)).cast("decimal(14,2)")
    terms = F.when(F.col("o_orderkey") % 17 == 0, "NET45").when(F.col("o_orderkey") % 3 == 0, "net-30").otherwise("Net 30")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("ingest_seq"),
        F.col("o_orderkey").alias("document_id"),
        F.concat(F.initcap(F.substring(word, 1, 8)), F.lit(" "), F.initcap(F.substring(word, 9, 6)), suffix).alias("vendor"),
        F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("invoice_number"),
        F.to_date("o_orderdate").alias("issue_date"),
        total.alias("total"),
        F.when(F.col("c_nationkey") % 3 == 0, "AED").when(F.col("c_nationkey") % 3 == 1, "USD").otherwise("EUR").alias("currency"),
        terms.alias("payment_terms"),
        F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "NEEDS_REVIEW").otherwise("PROCESSING").alias("status"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        ((F.col("o_orderkey") * 37) % 500).cast("int").alias("latency_ms"),
        ((F.col("o_orderkey") * 13) % 9000 / 1000000).cast("decimal(12,6)").alias("cost_usd"),
    )


INVOICES = """invoices AS (
  SELECT o_orderkey AS ingest_seq, o_orderkey AS document_id,
    upper(substr(w, 1, 1)) || substr(w, 2, 7) || ' ' || upper(substr(w, 9, 1)) || substr(w, 10, 5) || [' LLC', ' L.L.C.', ' FZ-LLC', ', Inc.', ''][o_orderkey % 5 + 1] AS vendor,
    'INV-' || o_orderkey AS invoice_number, CAST(o_orderdate AS DATE) AS issue_date,
    CAST(CASE WHEN o_orderkey % 40 = 0 THEN round(o_totalprice, -3) ELSE round(o_totalprice, 2) END AS DECIMAL(14,2)) AS total,
    CASE c_nationkey % 3 WHEN 0 THEN 'AED' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
    CASE WHEN o_orderkey % 17 = 0 THEN 'NET45' WHEN o_orderkey % 3 = 0 THEN 'net-30' ELSE 'Net 30' END AS payment_terms,
    CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'NEEDS_REVIEW' ELSE 'PROCESSING' END AS status,
    CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST((o_orderkey * 37) % 500 AS INTEGER) AS latency_ms,
    CAST(((o_orderkey * 13) % 9000) / 1000000.0 AS DECIMAL(12,6)) AS cost_usd
  FROM (SELECT *, translate(md5(CAST(o_custkey AS VARCHAR)), '0123456789', 'ghijklmnop') AS w FROM orders) JOIN customer ON o_custkey = c_custkey)"""


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed lines; every thirteenth has a unit price that is one too high."""
    off = F.when((F.col("l_orderkey") + F.col("l_partkey")) % 13 == 0, F.lit(1)).otherwise(F.lit(0))
    amount = F.round("l_extendedprice", 2).cast("decimal(18,6)")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_linenumber").alias("line"),
        F.col("l_quantity").cast("decimal(18,6)").alias("qty"),
        (F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4) + off).cast("decimal(18,6)").alias("unit_price"),
        amount.alias("amount"),
    )


LINE_ITEMS = """line_items AS (
  SELECT l_orderkey AS document_id, l_partkey AS part, l_linenumber AS line, CAST(l_quantity AS DECIMAL(18,6)) AS qty,
    CAST(round(l_extendedprice / l_quantity, 4) + CASE WHEN (l_orderkey + l_partkey) % 13 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,6)) AS unit_price,
    CAST(round(l_extendedprice, 2) AS DECIMAL(18,6)) AS amount
  FROM lineitem)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted records for validation: invoices with their lines and printed totals, some of them wrong or missing."""
    lines = line_items(spark, sf_dir).groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("line", "part", "qty", "unit_price", "amount"))).alias("line_items"), F.sum("amount").alias("lines_sum"))
    joined = invoices(spark, sf_dir).join(lines.hint("merge"), "document_id", "left")  # both sides grow alike, and what follows wants many tasks
    k = F.col("document_id")
    subtotal = F.coalesce((F.col("lines_sum") + F.when(k % 23 == 0, 500).otherwise(0)).cast("decimal(18,6)"), F.col("total").cast("decimal(18,6)"))
    joined = joined.withColumn("subtotal", subtotal)
    tax = F.when(k % 19 == 0, F.lit(None)).when(F.col("currency") == "AED", F.bround(F.col("subtotal") * F.lit(0.05).cast("decimal(4,2)"), 2) + F.when(k % 7 == 0, 9).otherwise(0)).otherwise(0)
    joined = joined.withColumn("tax", tax.cast("decimal(18,6)"))
    printed = F.col("subtotal") + F.coalesce("tax", F.lit(0)) + F.when(k % 10 == 0, 450).otherwise(0)
    return joined.select(
        "document_id", "ingest_seq", F.when(k % 29 != 0, F.col("vendor")).alias("vendor"), "invoice_number", "issue_date",
        F.when(k % 3 > 0, F.date_add("issue_date", F.when(k % 31 == 0, -5).otherwise(30))).alias("due_date"),
        "currency", "payment_terms", "subtotal", "tax", printed.cast("decimal(18,6)").alias("total"), F.coalesce("line_items", F.array()).alias("line_items"),
    )


RECORDS = (
    LINE_ITEMS
    + """,
lines_of AS (SELECT document_id, CAST(sum(amount) AS DECIMAL(18,6)) AS lines_sum FROM line_items GROUP BY document_id),
sub_of AS (SELECT i.*, coalesce(CAST(lines_sum + CASE WHEN i.document_id % 23 = 0 THEN 500 ELSE 0 END AS DECIMAL(18,6)), CAST(total AS DECIMAL(18,6))) AS subtotal FROM invoices i LEFT JOIN lines_of USING (document_id)),
tax_of AS (SELECT *, CAST(CASE WHEN document_id % 19 = 0 THEN NULL WHEN currency = 'AED' THEN round_even(CAST(subtotal AS DECIMAL(18,6)) * CAST(0.05 AS DECIMAL(4,2)), 2) + CASE WHEN document_id % 7 = 0 THEN 9 ELSE 0 END ELSE 0 END AS DECIMAL(18,6)) AS tax FROM sub_of),
records AS (
  SELECT document_id, ingest_seq, CASE WHEN document_id % 29 <> 0 THEN vendor END AS vendor, invoice_number, issue_date,
    CASE WHEN document_id % 3 > 0 THEN CAST(issue_date + CAST(CASE WHEN document_id % 31 = 0 THEN -5 ELSE 30 END AS INTEGER) AS DATE) END AS due_date,
    currency, payment_terms, subtotal, tax, CAST(subtotal + coalesce(tax, 0) + CASE WHEN document_id % 10 = 0 THEN 450 ELSE 0 END AS DECIMAL(18,6)) AS total
  FROM tax_of)"""
)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log: the kinds of events stand for steps of a document's way."""
    e = table(spark, sf_dir, "events")
    event = (
        F.when(F.col("event_type") == "signup", "document.received").when(F.col("event_type") == "view", "pipeline.routed").when(F.col("event_type") == "click", "pipeline.extraction_succeeded")
        .when(F.col("value") < 20, "job.failed").when(F.col("value") < 60, "pipeline.anomaly_raised").when(F.col("value") < 100, "pipeline.validation_failed")
        .when(F.col("value") < 140, "pipeline.validation_passed").when(F.col("event_type") == "error", "pipeline.screening_completed").otherwise("ledger.committed")
    )
    stage = F.element_at(F.array(*map(F.lit, ("ingest", "route", "extract", "validate", "screen", "ledger"))), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"), event.alias("event"), stage.alias("stage"), F.col("props").alias("payload"), F.col("ts").alias("created_at"), "value")


AUDIT_LOG = """audit_log AS (
  SELECT event_id AS id, user_id AS document_id,
    CASE WHEN event_type = 'signup' THEN 'document.received' WHEN event_type = 'view' THEN 'pipeline.routed' WHEN event_type = 'click' THEN 'pipeline.extraction_succeeded'
      WHEN value < 20 THEN 'job.failed' WHEN value < 60 THEN 'pipeline.anomaly_raised' WHEN value < 100 THEN 'pipeline.validation_failed'
      WHEN value < 140 THEN 'pipeline.validation_passed' WHEN event_type = 'error' THEN 'pipeline.screening_completed' ELSE 'ledger.committed' END AS event,
    ['ingest', 'route', 'extract', 'validate', 'screen', 'ledger'][event_id % 6 + 1] AS stage, props AS payload, ts AS created_at, value
  FROM events)"""


def anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings awaiting review, one for each event of a kind."""
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'purchase')")
    return e.select(
        F.col("event_id").alias("id"), (F.col("event_id") % F.lit(1499)).alias("document_id"),
        F.element_at(F.array(*map(F.lit, ("duplicate", "amount_zscore", "term_drift", "round_number"))), (F.col("event_id") % 4 + 1).cast("int")).alias("anomaly_type"),
        F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (F.col("event_id") % 3 + 1).cast("int")).alias("severity"),
        F.when(F.col("value") < 90, "OPEN").when(F.col("value") < 150, "APPROVED").otherwise("REJECTED").alias("status"),
        F.col("ts").alias("created_at"),
    )


ANOMALIES = """anomalies AS (
  SELECT event_id AS id, event_id % 1499 AS document_id, ['duplicate', 'amount_zscore', 'term_drift', 'round_number'][event_id % 4 + 1] AS anomaly_type,
    ['LOW', 'MEDIUM', 'HIGH'][event_id % 3 + 1] AS severity, CASE WHEN value < 90 THEN 'OPEN' WHEN value < 150 THEN 'APPROVED' ELSE 'REJECTED' END AS status, ts AS created_at
  FROM events WHERE event_type IN ('error', 'purchase'))"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model calls: each turn of a conversation is one."""
    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit("")))
    tokens = F.greatest(F.lit(1), F.floor(n / 4)).cast("long")
    model = F.when(F.col("role") == "user", "large").when(F.col("role") == "assistant", "medium").otherwise("unlisted")
    return c.select(F.col("conv_id").alias("document_id"), "turn", model.alias("model"), tokens.alias("input_tokens"), F.floor(tokens / 2).cast("long").alias("output_tokens"), F.date_add(F.lit("2026-08-25").cast("date"), (F.col("conv_id") % 14).cast("int")).alias("called_on"))


TRACES = """traces AS (
  SELECT conv_id AS document_id, turn, CASE role WHEN 'user' THEN 'large' WHEN 'assistant' THEN 'medium' ELSE 'unlisted' END AS model,
    greatest(1, length(coalesce(text, '')) // 4) AS input_tokens, greatest(1, length(coalesce(text, '')) // 4) // 2 AS output_tokens,
    CAST(DATE '2026-08-25' + CAST(conv_id % 14 AS INTEGER) AS DATE) AS called_on
  FROM conversations)"""

#: All views but records, which are built on some of them.
WITH = "WITH " + ",\n".join((INVOICES, AUDIT_LOG, ANOMALIES, TRACES))
WITH_RECORDS = WITH + ",\n" + RECORDS
