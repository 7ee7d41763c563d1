"""The ledger's aggregates, lists and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_RANK = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
TERMINAL = ["DONE", "NEEDS_REVIEW", "FAILED"]
#: More than there are statuses.
STATUSES = 64


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2).when(severity == "LOW", 1).otherwise(0)


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def latency_cost(invoices: DataFrame) -> DataFrame:
    """Average and interpolated 95th percentile of latency, cost and cost a document over terminal documents; zeros when there are none."""
    ended = invoices.where(F.col("status").isin(TERMINAL) & F.col("latency_ms").isNotNull())
    found = ended.agg(
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY latency_ms)"), F.lit(0.0)).alias("p95_latency_ms"),
        F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("total_cost_usd"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(F.col("status").isin("DONE", "NEEDS_REVIEW"), 1)).alias("n_read"),
    )
    average = F.when(F.col("n_read") > 0, F.round(F.col("total_cost_usd") / F.col("n_read"), 6)).otherwise(0.0)
    return found.select(F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("p95_latency_ms", 6).alias("p95_latency_ms"), F.round("total_cost_usd", 6).alias("total_cost_usd"), "n", average.alias("avg_cost_usd"))


def vendor_spend(invoices: DataFrame, top: int = 8, by_currency: bool = False) -> DataFrame:
    """The vendors, as spelled, with the largest sums of totals. One currency is shown for a vendor, the last by name, unless ``by_currency``."""
    by = ["vendor", "currency"] if by_currency else ["vendor"]
    found = invoices.where("vendor is not null and total is not null").groupBy(*by).agg(F.sum("total").cast("double").alias("spend"), F.count(F.lit(1)).alias("invoices"), F.max("currency").alias("shown_currency"))
    return found.orderBy(F.desc("spend"), *by).limit(top)


def open_flags(anomalies: DataFrame) -> DataFrame:
    """Per document: number of open findings and the gravest severity."""
    rank = severity_rank(F.col("severity"))
    return anomalies.where("status = 'OPEN'").groupBy("document_id").agg(F.count(F.lit(1)).alias("flags"), F.max_by("severity", rank).alias("severity"))


def document_page(invoices: DataFrame, anomalies: DataFrame, status: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of documents, newest first, with their open flags. The page is cut before the join, which then meets a page's ids only."""
    page = invoices if status is None else invoices.where(F.col("status") == status)
    page = page.orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit)
    flags = open_flags(anomalies.join(F.broadcast(page.select("document_id")), "document_id", "left_semi"))
    found = page.join(flags, "document_id", "left")
    return found.select("document_id", "vendor", "invoice_number", F.col("total").cast("double").alias("total"), "status", "created_at", F.coalesce("flags", F.lit(0)).alias("flags"), "severity")


def review_queue(anomalies: DataFrame, invoices: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Open findings, gravest and newest first. Ordered and cut before vendors are looked up."""
    known = anomalies.where("status = 'OPEN'").join(invoices.select("document_id"), "document_id", "left_semi")
    page = known.withColumn("rank", severity_rank(F.col("severity"))).orderBy(F.desc("rank"), F.desc("created_at"), "id").offset(offset).limit(limit)
    return page.join(invoices.select("document_id", "vendor"), "document_id", "left").select("id", "document_id", "vendor", "anomaly_type", "severity", "rank", "created_at")


def reconcile(invoices: DataFrame) -> DataFrame:
    """Each status's count, the count that a list of all gives, and whether sums agree: one row a status."""
    per = invoices.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    whole = invoices.agg(F.count(F.lit(1)).alias("listed"))
    total = per.agg(F.sum("n").alias("counted"))
    return per.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total)).select("status", "n", "listed", (F.col("listed") == F.col("counted")).alias("agrees"))


def nearest_rank_p95(df: DataFrame, by: str, value: str) -> DataFrame:
    """The value at index min(floor(0.95 n), n - 1) of each group's ascending values, from counts of distinct values: no group is gathered."""
    from pyspark.sql import Window

    spread = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("k"))
    upto = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = spread.withColumn("upto", F.sum("k").over(upto)).withColumn("n", F.sum("k").over(Window.partitionBy(by)))
    wanted = F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)
    return spread.where((F.col("upto") > wanted) & (F.col("upto") - F.col("k") <= wanted)).select(by, F.col(value).alias("p95"), "n")


def dashboard(invoices: DataFrame, top: int = 8) -> DataFrame:
    """The dashboard's sections in one pass over the invoices: section, status, vendor, currency, n, spend, cost_usd, avg_latency_ms.

    Sections: ``status``, ``ended`` (terminal documents with a latency), ``vendor`` and ``vendor_currency`` (the ``top`` by spend). One aggregation by grouping sets, with what a section counts as its filter; the largest vendors are cut from its result.
    """
    ended = F.col("status").isin(TERMINAL) & F.col("latency_ms").isNotNull()
    billed = F.col("vendor").isNotNull() & F.col("total").isNotNull()
    rows = invoices.select("status", "vendor", "currency", F.when(billed, F.col("total")).alias("total"), "cost_usd", "latency_ms", ended.alias("ended"), billed.alias("billed"))
    sets = rows.groupingSets([[F.col("status")], [F.col("vendor")], [F.col("vendor"), F.col("currency")], []], F.col("status"), F.col("vendor"), F.col("currency"))
    found = sets.agg(
        F.grouping_id().alias("id"), F.count(F.lit(1)).alias("rows"), F.count_if("ended").alias("ended"), F.count_if("billed").alias("billed"), F.sum("total").cast("double").alias("spend"),
        F.coalesce(F.sum(F.when(F.col("ended"), F.col("cost_usd"))), F.lit(0)).cast("double").alias("cost_usd"), F.round(F.coalesce(F.avg(F.when(F.col("ended"), F.col("latency_ms"))), F.lit(0.0)), 6).alias("avg_latency_ms"),
    )
    section = F.when(F.col("id") == 3, "status").when(F.col("id") == 5, "vendor").when(F.col("id") == 4, "vendor_currency").otherwise("ended")
    found = found.withColumn("section", section)
    place = Window.partitionBy("section").orderBy(F.desc_nulls_last("spend"), "vendor", "currency")
    found = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= max(top, STATUSES))  # cut before the shuffle, and so in each task
    by_vendor = F.col("section").startswith("vendor")
    found = found.where(~by_vendor | (F.col("place") <= top) & (F.col("billed") > 0))
    n = F.when(by_vendor, F.col("billed")).when(F.col("section") == "ended", F.col("ended")).otherwise(F.col("rows"))
    of_ended = lambda c: F.when(F.col("section") == "ended", c)
    return found.select("section", "status", "vendor", "currency", n.alias("n"), F.when(by_vendor, F.col("spend")).alias("spend"), of_ended(F.round("cost_usd", 6)).alias("cost_usd"), of_ended(F.col("avg_latency_ms")).alias("avg_latency_ms"))
