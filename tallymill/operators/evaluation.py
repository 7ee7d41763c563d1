"""Scores of extracted fields and found anomalies against what is expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import squeeze, vendor_key

FIELDS = ["vendor", "invoice_number", "issue_date", "due_date", "subtotal", "tax", "total", "currency", "payment_terms"]


def field_matches(field: str, expected: Column, observed: Column) -> Column:
    """Both empty match, one doesn't; amounts within a cent, dates exactly, vendors by key, numbers without spaces, text in lower case."""
    e, o = (F.nullif(F.trim(c.cast("string")), F.lit("")) for c in (expected, observed))
    if field in ("subtotal", "tax", "total"):
        same = F.abs(expected - observed) <= F.lit("0.01").cast("decimal(4,2)")
    elif field in ("issue_date", "due_date"):
        same = expected == observed
    elif field == "vendor":
        same = vendor_key(e) == vendor_key(o)
    elif field == "invoice_number":
        same = F.lower(F.regexp_replace(e, r"\s", "")) == F.lower(F.regexp_replace(o, r"\s", ""))
    else:
        same = F.lower(squeeze(e)) == F.lower(squeeze(o))
    return F.when(e.isNull() & o.isNull(), True).when(e.isNull() | o.isNull(), False).otherwise(F.coalesce(same, F.lit(False)))


def field_accuracy(pairs: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Per field of rows with expected and observed structs: correct, n, accuracy. One pass, counted before anything is shuffled."""
    long = pairs.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), field_matches(f, F.col(f"expected.{f}"), F.col(f"observed.{f}")).alias("hit")) for f in fields))).alias("m"))
    return long.groupBy("m.field").agg(F.count(F.when(F.col("m.hit"), 1)).alias("correct"), F.count(F.lit(1)).alias("n")).withColumn("accuracy", F.round(F.col("correct") / F.col("n"), 6))


def population_scores(results: DataFrame, manifest: DataFrame, fields: list[str] = FIELDS, offline: bool = True) -> DataFrame:
    """Per population, never averaged together: documents (read), unreadable, correct, n, accuracy.

    ``results``: filename, population, observed; ``manifest``: filename, is_scan, expected; joined by name. Offline, a scan of which no
    vendor was read is unreadable: it is counted and not scored. Populations are put together by ``unionByName`` before.
    """
    both = results.join(manifest, "filename")
    read = ~(F.lit(offline) & F.coalesce("is_scan", F.lit(False)) & (F.coalesce(F.trim("observed.vendor"), F.lit("")) == ""))
    hits = sum((field_matches(f, F.col(f"expected.{f}"), F.col(f"observed.{f}")).cast("long") for f in fields), F.lit(0).cast("long"))
    scored = both.select("population", read.alias("read"), hits.alias("hits"))
    found = scored.groupBy("population").agg(F.count(F.when(F.col("read"), 1)).alias("documents"), F.count(F.when(~F.col("read"), 1)).alias("unreadable"), F.coalesce(F.sum(F.when(F.col("read"), F.col("hits"))), F.lit(0)).alias("correct"))
    n = F.col("documents") * len(fields)
    return found.select("population", "documents", "unreadable", "correct", n.alias("n"), F.round(F.when(n > 0, F.col("correct") / n), 6).alias("accuracy"))


def as_labelled(expected: Column, observed: Column) -> Column:
    """Whether just the expected kinds were found, in any order."""
    return F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(observed))


def line_item_score(expected: Column, observed: Column, slack: str = "0.01") -> Column:
    """How many lines agree in amount, place by place, up to the shorter list's end."""
    both = F.slice(F.arrays_zip(expected.alias("e"), observed.alias("o")), F.lit(1), F.greatest(F.lit(1), F.least(F.size(expected), F.size(observed))))
    hits = F.size(F.filter(both, lambda p: F.coalesce(F.abs(p["e"] - p["o"]) <= F.lit(slack).cast("decimal(6,4)"), F.lit(False))))
    return F.when((F.size(expected) == 0) | (F.size(observed) == 0), 0).otherwise(hits)


def precision_recall(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over rows with arrays expected and observed; without cases precision and recall are 1, f1 is 0."""
    sums = pairs.agg(
        F.coalesce(F.sum(F.size(F.array_intersect("expected", "observed"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.size(F.array_except("observed", "expected"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.size(F.array_except("expected", "observed"))), F.lit(0)).alias("fn"),
    )
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(1.0)
    return sums.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def blocked_expectations(invoices: DataFrame, least_history: int = 4) -> DataFrame:
    """Which expectations can't be met as too little readable history came before: per invoice readable_before, zscore_blocked, duplicate_blocked."""
    before = Window.partitionBy("vendor").orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.when(F.col("readable"), 1)).over(before)
    return invoices.select("document_id", n.alias("readable_before"), (n < least_history).alias("zscore_blocked"), (n == 0).alias("duplicate_blocked"))


def unexplained(findings: DataFrame, kinds: list[str] = ("LOW", "MEDIUM", "HIGH", "CRITICAL")) -> DataFrame:
    """Findings that a reviewer can't act on: id and gaps, the names of what is missing of severity, score, reason and evidence.

    evidence: JSON text of an object with something in it; it is parsed once. findings: id, severity, score, reason, evidence.
    """
    evidence = F.try_parse_json("evidence")
    filled = F.coalesce(F.schema_of_variant(evidence).startswith("OBJECT<") & (F.schema_of_variant(evidence) != "OBJECT<>"), F.lit(False))
    gaps = [("severity", F.coalesce(F.col("severity").isin(list(kinds)), F.lit(False))), ("score", F.col("score").isNotNull() & ~F.isnan(F.col("score").cast("double"))), ("reason", F.coalesce(F.trim("reason"), F.lit("")) != ""), ("evidence", filled)]
    missing = F.filter(F.array(*(F.when(~there, name) for name, there in gaps)), lambda g: g.isNotNull())
    return findings.select("id", missing.alias("gaps")).where(F.size("gaps") > 0)
