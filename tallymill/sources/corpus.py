"""Made-up ledgers whose labels are known: near copies of invoices that were there before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def raised_price(qty: Column, unit_price: Column, total: Column, gap: float = 0.004) -> Column:
    """The last line's unit price at which an invoice's total is ``gap`` above ``total``, to the cent; the rate of tax cancels out."""
    return F.round(unit_price + total * gap / qty, 2)


def near_copies(invoices: DataFrame, last_lines: DataFrame, gap: float = 0.004, days: int = 3) -> DataFrame:
    """Invoices, and for each with a last line a copy that arrives after them all under another number, some days later and ``gap`` dearer.

    ``last_lines``: document_id, qty, unit_price. A copy's document_id is -1 less the original's, which isn't negative; ``original_id`` is null for originals.
    """
    q, p, total = F.col("qty").cast("double"), F.col("unit_price").cast("double"), F.col("total").cast("double")
    made = invoices.join(last_lines.select("document_id", "qty", "unit_price"), "document_id").where("qty > 0 and total > 0")
    last = invoices.agg(F.max("ingest_seq").alias("last"))
    copies = made.crossJoin(F.broadcast(last)).withColumns({  # one row
        "total": (total + q * (raised_price(q, p, total, gap) - p)).cast("decimal(14,2)"), "original_id": F.col("document_id"), "document_id": -1 - F.col("document_id"), "ingest_seq": F.col("last") + F.col("ingest_seq"),
        "invoice_number": F.concat("invoice_number", F.lit("-B")), "issue_date": F.date_add("issue_date", days),
    })
    columns = [*invoices.columns, "original_id"]
    return invoices.withColumn("original_id", F.lit(None).cast("long")).select(columns).unionByName(copies.select(columns))


#: Vendors of a made-up corpus, and invoices of each before what is planted.
VENDORS, INVOICES = 8, 6


def worlds(customers: DataFrame, seeds: int) -> DataFrame:
    """Small labelled corpora, each drawn once for each seed: corpus, seed, the columns of invoices, and expected (kinds of findings).

    ``VENDORS`` customers make a corpus. Each bills ``INVOICES`` times, some weeks apart, within 3 % of its usual amount as the seed has it. The first vendor's last invoice is billed again days later, the second's last is eight
    times the usual, the third's has other terms, the fourth's is a whole thousand. Vendors of two seeds never share a name, so all worlds can go through the detectors at once.
    """
    c = F.col("c_custkey")
    u = lambda *parts: F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    place, corpus = F.pmod(c, F.lit(VENDORS)), F.floor(c / VENDORS)
    drawn = customers.select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    word = F.translate(F.md5(F.concat_ws(":", c, "seed").cast("binary")), "0123456789", "ghijklmnop")
    drawn = drawn.withColumns({"corpus": corpus, "place": place, "vendor": F.concat(F.initcap(F.substring(word, 1, 8)), F.lit(" "), F.initcap(F.substring(word, 9, 6)), F.lit(" LLC"))})
    usual = F.lit(1000) + F.floor(u(F.lit("usual"), c) * 9000)
    usual = F.when(F.col("place") == 3, F.ceil(usual / 1000) * 1000).otherwise(usual)
    rows = drawn.withColumn("usual", usual).withColumn("nth", F.explode(F.sequence(F.lit(0), F.when(F.col("place") == 0, INVOICES).otherwise(INVOICES - 1))))
    last, billed = F.col("nth") == INVOICES - 1, F.least(F.col("nth"), F.lit(INVOICES - 1))
    amount = F.round(F.col("usual") * (1 + 0.03 * (2 * u(F.lit("amount"), c, F.col("seed"), billed) - 1)), 2)
    amount = F.when(F.col("nth") == INVOICES, F.round(amount * 1.004, 2)).when(last & (F.col("place") == 1), amount * 8).when(last & (F.col("place") == 3), F.col("usual")).otherwise(amount)
    days = billed * 25 + F.when(F.col("nth") == INVOICES, 3).otherwise(0)
    label = F.when(F.col("nth") == INVOICES, "duplicate").when(last & (F.col("place") == 1), "amount_zscore").when(last & (F.col("place") == 2), "term_drift").when(last & (F.col("place") == 3), "round_number")
    number = ((F.col("corpus") * seeds + F.col("seed")) * VENDORS + F.col("place")) * (INVOICES + 1) + F.col("nth")
    return rows.select(
        "corpus", "seed", number.cast("long").alias("ingest_seq"), number.cast("long").alias("document_id"), "vendor", F.lit(None).cast("string").alias("invoice_number"), F.date_add(F.lit("2026-01-05").cast("date"), days.cast("int")).alias("issue_date"),
        amount.cast("decimal(14,2)").alias("total"), F.lit("AED").alias("currency"), F.when(last & (F.col("place") == 2), "Net 60").otherwise("Net 30").alias("payment_terms"), F.filter(F.array(label), lambda x: x.isNotNull()).alias("expected"),
    )


def self_check(labelled: DataFrame, findings: DataFrame) -> DataFrame:
    """corpus, seed, violations (documents that aren't found to be just what their label says) and chosen: the least seed of a corpus without any.

    labelled: corpus, seed, document_id, expected; findings: document_id, anomaly_type.
    """
    found = findings.groupBy("document_id").agg(F.collect_set("anomaly_type").alias("found"))
    right = F.array_sort("expected") == F.array_sort(F.coalesce("found", F.array().cast("array<string>")))
    held = labelled.join(found, "document_id", "left").groupBy("corpus", "seed").agg(F.count(F.when(~right, 1)).alias("violations"))
    best = held.groupBy("corpus").agg(F.min_by("seed", F.when(F.col("violations") == 0, F.col("seed"))).alias("best"))
    return held.join(best, "corpus").select("corpus", "seed", "violations", F.coalesce(F.col("seed") == F.col("best"), F.lit(False)).alias("chosen"))
