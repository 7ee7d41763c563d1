"""Reports that put several parts together, registered with the other queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import closed
from ..operators import evaluation, screening, stats
from ..sources import corpus, views
from ..sources.tables import dealt
from .catalog import _KEYED, _R, _T, _Z, ORACLES, query

SEEDS = 10
_U = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE"
_WORLDS = f"""WITH drawn AS (SELECT c_custkey, seed, c_custkey // 8 AS corpus, c_custkey % 8 AS place, translate(md5(c_custkey || ':' || seed), '0123456789', 'ghijklmnop') AS w, 1000 + CAST(floor({_U.format("'usual:' || c_custkey")} * 9000) AS BIGINT) AS about
  FROM customer, range({SEEDS}) r(seed)),
usuals AS (SELECT * EXCLUDE (about), CASE WHEN place = 3 THEN CAST(ceil(about / 1000.0) * 1000 AS BIGINT) ELSE about END AS usual FROM drawn),
billings AS (SELECT *, least(nth, 5) AS billed, round(usual * (1 + 0.03::DOUBLE * (2 * {_U.format("'amount:' || c_custkey || ':' || seed || ':' || least(nth, 5)")} - 1)), 2) AS amount FROM usuals, range(7) r(nth) WHERE nth < 6 OR place = 0),
labelled AS (SELECT corpus, seed, ((corpus * {SEEDS} + seed) * 8 + place) * 7 + nth AS document_id, ((corpus * {SEEDS} + seed) * 8 + place) * 7 + nth AS ingest_seq,
    upper(substr(w, 1, 1)) || substr(w, 2, 7) || ' ' || upper(substr(w, 9, 1)) || substr(w, 10, 5) || ' LLC' AS vendor, CAST(DATE '2026-01-05' + CAST(billed * 25 + CASE WHEN nth = 6 THEN 3 ELSE 0 END AS INTEGER) AS DATE) AS issue_date,
    CAST(CASE WHEN nth = 6 THEN round(amount * 1.004::DOUBLE, 2) WHEN nth = 5 AND place = 1 THEN amount * 8 WHEN nth = 5 AND place = 3 THEN usual ELSE amount END AS DECIMAL(14,2)) AS total, 'AED' AS currency,
    CASE WHEN nth = 5 AND place = 2 THEN 'Net 60' ELSE 'Net 30' END AS payment_terms,
    CASE WHEN nth = 6 THEN 'duplicate' WHEN nth = 5 AND place = 1 THEN 'amount_zscore' WHEN nth = 5 AND place = 2 THEN 'term_drift' WHEN nth = 5 AND place = 3 THEN 'round_number' END AS label FROM billings),
invoices AS (SELECT * FROM labelled)"""

ORACLES["corpus_self_check"] = f"""{_WORLDS}, {_KEYED}, near AS (SELECT c.document_id FROM keyed c JOIN keyed h ON h.vendor_key = c.vendor_key AND h.ingest_seq < c.ingest_seq AND abs(date_diff('day', h.issue_date, c.issue_date)) <= 7
    AND abs(c.total - h.total) <= CAST(0.01 AS DECIMAL(4,2)) * greatest(abs(c.total), abs(h.total))), {_Z}, {_T}, {_R},
found AS (SELECT document_id, 'duplicate' AS t FROM near UNION SELECT document_id, anomaly_type FROM d2 UNION SELECT document_id, anomaly_type FROM d3 UNION SELECT document_id, anomaly_type FROM d4),
kinds AS (SELECT document_id, list(t ORDER BY t) AS kinds FROM found GROUP BY 1),
held AS (SELECT corpus, seed, count(*) FILTER (coalesce(kinds, []) <> CASE WHEN label IS NULL THEN [] ELSE [label] END) AS violations FROM labelled LEFT JOIN kinds USING (document_id) GROUP BY ALL)
SELECT corpus, CAST(seed AS INTEGER) AS seed, violations, violations = 0 AND seed = min(CASE WHEN violations = 0 THEN seed END) OVER (PARTITION BY corpus) AS chosen FROM held"""


@query()
def corpus_self_check(spark, d):
    """Corpora drawn from customers for every seed at once, screened, and held against their labels; of each the first seed without violations is chosen."""
    labelled = corpus.worlds(dealt(views.table(spark, d, "customer").select("c_custkey")), SEEDS)  # a few numbers each, and much made of them
    found = screening.screen(labelled, screening.Limits(similarity=100.0))
    return corpus.self_check(labelled, found).withColumn("seed", F.col("seed").cast("int"))


@query(
    """WITH parts AS (
  SELECT 'status' AS section, status, NULL AS vendor, NULL AS currency, count(*) AS n, NULL::DOUBLE AS spend, NULL::DOUBLE AS cost_usd, NULL::DOUBLE AS avg_latency_ms FROM invoices GROUP BY status
  UNION ALL SELECT 'ended', NULL, NULL, NULL, count(*), NULL, round(CAST(coalesce(sum(cost_usd), 0) AS DOUBLE), 6), round(coalesce(avg(latency_ms), 0), 6) FROM invoices WHERE status IN ('DONE', 'NEEDS_REVIEW', 'FAILED')
  UNION ALL (SELECT 'vendor', NULL, vendor, NULL, count(*), CAST(sum(total) AS DOUBLE) AS spend, NULL, NULL FROM invoices GROUP BY vendor ORDER BY spend DESC, vendor LIMIT 8)
  UNION ALL (SELECT 'vendor_currency', NULL, vendor, currency, count(*), CAST(sum(total) AS DOUBLE) AS spend, NULL, NULL FROM invoices GROUP BY vendor, currency ORDER BY spend DESC, vendor, currency LIMIT 8))
SELECT * FROM parts"""
)
def dashboard(spark, d):
    return stats.dashboard(views.invoices(spark, d))


_NUMBERED = "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN 'no json' WHEN 3 THEN '[1]' ELSE props END"


@query(
    f"""WITH said AS (SELECT event_id AS id, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL', 'URGENT', NULL][event_id % 6 + 1] AS severity, CASE WHEN value < 400 THEN value END AS score, nullif(trim(session_note), '') AS reason, {_NUMBERED} AS evidence
  FROM (SELECT *, CASE WHEN value > 200 THEN event_type || ' of ' || user_id WHEN value > 100 THEN '  ' END AS session_note FROM events)),
gaps AS (SELECT id, list_filter([CASE WHEN severity IS NULL OR severity NOT IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN 'severity' END, CASE WHEN score IS NULL THEN 'score' END, CASE WHEN reason IS NULL THEN 'reason' END,
    CASE WHEN json_valid(evidence) IS NOT TRUE OR CASE WHEN json_valid(evidence) THEN json_type(evidence) END <> 'OBJECT' OR CASE WHEN json_valid(evidence) THEN len(json_keys(evidence)) END = 0 THEN 'evidence' END], lambda x: x IS NOT NULL) AS gaps FROM said)
SELECT id, array_to_string(gaps, ', ') AS gaps FROM gaps WHERE len(gaps) > 0"""
)
def unexplained_findings(spark, d):
    """Findings made of events, some without legal severity, score, reason or evidence: each is told with what it lacks."""
    e = views.table(spark, d, "events")
    reason = F.when(F.col("value") > 200, F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string"))).when(F.col("value") > 100, "  ")
    severity = F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH", "CRITICAL", "URGENT", None))), (F.col("event_id") % 6 + 1).cast("int"))
    rows = e.select(F.col("event_id").alias("id"), severity.alias("severity"), F.when(F.col("value") < 400, F.col("value")).alias("score"), reason.alias("reason"), F.expr(_NUMBERED).alias("evidence"))
    return evaluation.unexplained(rows).select("id", F.array_join("gaps", ", ").alias("gaps"))


RECORD = T.StructType([
    T.StructField("vendor", T.StringType(), False), T.StructField("total", T.DecimalType(18, 6), False), T.StructField("issue_date", T.StringType()),
    T.StructField("line_items", T.ArrayType(T.StructType([T.StructField("description", T.StringType()), T.StructField("amount", T.DecimalType(18, 6), False)])), False),
])
#: The same text in Spark and DuckDB: records as a model may write them, of what is in the table.
_WRITTEN = """concat('{"vendor": ', CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS STRING) WHEN o_orderkey % 17 = 0 THEN 'null' ELSE concat('"', o_orderpriority, '"') END, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN concat(', "total": "', o_orderstatus, '"') ELSE concat(', "total": ', CAST(o_custkey AS STRING), '.25') END,
  CASE WHEN o_orderkey % 13 = 0 THEN ', "notes": true, "also": {}' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN ', "issue_date": null' WHEN o_orderkey % 8 = 0 THEN ', "issue_date": 20260101' ELSE '' END, ', "line_items": ',
  CASE WHEN o_orderkey % 19 = 0 THEN '{}' WHEN o_orderkey % 4 = 0 THEN '[{"description": "a", "amount": 1}, {"amount": "x", "qty": 2}, 7, {"description": false}, {"amount": 1.5, "more": [1], "odd": 1}]' ELSE '[]' END, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '}' END)"""


def _typed(path: str, where: str, kinds: str, said: str, required: bool) -> str:
    missing = f"WHEN json_type({where}) IS NULL THEN " + (f"['{path}: {closed.MISSING}']" if required else "[]")
    null = "" if required else f" WHEN json_type({where}) = 'NULL' THEN []"
    return f"CASE {missing}{null} WHEN json_type({where}) NOT IN ({kinds}) THEN ['{path}: {said}'] ELSE [] END"


_NUMBER, _STRING = "'UBIGINT', 'BIGINT', 'DOUBLE'", "'VARCHAR'"
_LINES = ", ".join(
    f"CASE WHEN json_type(j, '$.line_items[{i}]') IS NULL THEN [] WHEN json_type(j, '$.line_items[{i}]') <> 'OBJECT' THEN ['line_items.{i}: {closed.WANTED['object']}'] ELSE list_concat("
    + _typed(f"line_items.{i}.description", f"j, '$.line_items[{i}].description'", _STRING, closed.WANTED["string"], False) + ", "
    + _typed(f"line_items.{i}.amount", f"j, '$.line_items[{i}].amount'", _NUMBER, closed.WANTED["number"], True)
    + f", [('line_items.{i}.' || k || ': {closed.SPARE}') FOR k IN list_sort(json_keys(j, '$.line_items[{i}]')) IF k NOT IN ('description', 'amount')]) END"
    for i in range(5)
)


@query(
    f"""WITH written AS (SELECT o_orderkey AS document_id, {_WRITTEN} AS text FROM orders),
parsed AS (SELECT document_id, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS j FROM written),
errors AS (SELECT document_id, CASE WHEN j IS NULL THEN ['(root): {closed.NO_JSON}'] ELSE list_concat(
    {_typed("vendor", "j, '$.vendor'", _STRING, closed.WANTED["string"], True)}, {_typed("total", "j, '$.total'", _NUMBER, closed.WANTED["number"], True)}, {_typed("issue_date", "j, '$.issue_date'", _STRING, closed.WANTED["string"], False)},
    CASE WHEN json_type(j, '$.line_items') <> 'ARRAY' THEN ['line_items: {closed.WANTED["list"]}'] ELSE list_concat({_LINES}) END,
    [(k || ': {closed.SPARE}') FOR k IN list_sort(json_keys(j)) IF k NOT IN ('vendor', 'total', 'issue_date', 'line_items')]) END AS errors FROM parsed)
SELECT document_id, CAST(len(errors) AS INTEGER) AS errors, '{closed.HEADING}' || chr(10) || array_to_string([('- `' || replace(e, ': ', '`: ')) FOR e IN errors[1:6]], chr(10)) AS text FROM errors WHERE len(errors) > 0"""
)
def schema_error_lists(spark, d):
    """Written records against the closed schema of a record: how many errors, and the first six as text."""
    rows = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), closed.schema_errors(F.expr(_WRITTEN), RECORD).alias("errors"))
    return rows.where(F.size("errors") > 0).select("document_id", F.size("errors").alias("errors"), closed.errors_text(F.col("errors")).alias("text"))
