"""Files as documents: capped reads, label manifests, append-only and dead-letter sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import filename, media_type, upload_verdict

LABELS = """filename string, content_type string, is_scan boolean, expected_anomalies array<string>, tags array<string>,
  ground_truth struct<vendor: string, invoice_number: string, issue_date: string, due_date: string, subtotal: string, tax: string, total: string, currency: string,
    payment_terms: string, line_items: array<struct<description: string, qty: string, unit_price: string, amount: string>>>"""


def uploads(spark: SparkSession, folder: str, most_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files with hash, kind, safe name and verdict. Those over the cap aren't read: their length alone decides, before content is asked for."""
    files = spark.read.format("binaryFile").load(folder)
    small = files.where(F.col("length") <= most_bytes).withColumn("verdict", upload_verdict(F.col("content"), F.lit(None).cast("string"), most_bytes))
    large = files.where(F.col("length") > most_bytes).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary")).withColumn("verdict", F.lit("too_large"))
    both = small.unionByName(large)
    return both.select("path", filename(F.col("path")).alias("filename"), "length", F.sha2("content", 256).alias("file_hash"), media_type(F.col("content")).alias("media_type"), "verdict")


def label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Expected records; fields outside the schema are not read."""
    return spark.read.schema(LABELS).option("multiLine", True).json(path)


def missing_files(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Files that a manifest names and ``found`` (as ``uploads`` gives it) lacks."""
    return manifest.select("filename").distinct().join(found.select("filename"), "filename", "left_anti")


def encoded(content: Column) -> Column:
    """An image as text, in base64 on one line."""
    return F.translate(F.base64(content), "\r\n", "")


def append_audit(rows: DataFrame, folder: str) -> None:
    """The log only grows."""
    rows.write.mode("append").parquet(folder)


def dead_letters(rows: DataFrame) -> DataFrame:
    """Failed rows as jobs, reasons cut as the ledger holds them."""
    return rows.where("error_code is not null").withColumn("reason", F.substring("reason", 1, 4000)).withColumn("status_reason", F.substring("reason", 1, 1000))


def replace(rows: DataFrame, folder: str) -> None:
    """A table emptied and filled anew."""
    rows.write.mode("overwrite").parquet(folder)


def write_report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
