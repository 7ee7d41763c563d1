"""Screening at arrival: what each vendor's earlier invoices come to is state, findings are worked out as in batches.

A vendor's state is one row of sums and one small row for each of its terms, whatever the length of its history. Streams need the RocksDB state store (``STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import screening
from .sinks import Ledger

#: Settings that a session needs for state of this kind.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
GIVEN = "document_id string, ingest_seq long, vendor string, issue_date date, total decimal(14,2), currency string, payment_terms string, terms_key string"
SUMS = "n long, s1 decimal(38,2), s2 decimal(38,4), high decimal(14,2), low decimal(14,2), terms long, usual string, hits long"


class _Vendor(StatefulProcessor):
    """Invoices of a vendor, each with what came before it. Those of one batch are taken by ``ingest_seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", SUMS)
        self.terms = handle.getMapState("terms", "terms string", "times long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, s1, s2, high, low, terms, usual, hits = self.sums.get() if self.sums.exists() else (0, Decimal(0), Decimal(0), None, None, 0, None, 0)
        given = pd.concat(list(rows)).sort_values("ingest_seq", kind="stable", na_position="first")
        out = []
        for total, own in zip(given["total"], given["terms_key"], strict=True):
            out.append((n, s1, s2, high, low, terms, usual, hits))
            if total is not None and total == total:
                n, s1, s2 = n + 1, s1 + total, s2 + total * total
                high, low = (total, -total) if high is None else (max(high, total), max(low, -total))
            if own:
                times = (self.terms.getValue((own,))[0] if self.terms.containsKey((own,)) else 0) + 1
                self.terms.updateValue((own,), (times,))
                terms += 1
                hits, usual = max((hits, usual or ""), (times, own))
        self.sums.update((n, s1, s2, high, low, terms, usual, hits))
        yield pd.concat([given.reset_index(drop=True), pd.DataFrame(out, columns=["n", "s1", "s2", "high", "low", "terms", "usual", "hits"])], axis=1)

    def close(self) -> None:
        pass


def with_history(invoices: DataFrame) -> DataFrame:
    """A stream of invoices, each with sums over its vendor's that had arrived before; those without vendor's key have none."""
    names = [f.split()[0] for f in GIVEN.split(", ")]
    keyed = screening.keyed(invoices).withColumns({"document_id": F.col("document_id").cast("string"), "total": F.col("total").cast("decimal(14,2)")}).select("vendor_key", *names)
    return keyed.groupBy("vendor_key").transformWithStateInPandas(_Vendor(), f"vendor_key string, {GIVEN}, {SUMS}", "Append", "None")


def findings(rows: DataFrame, before: DataFrame | None = None, limits: screening.Limits = screening.Limits()) -> DataFrame:
    """Findings of a batch of ``with_history``, as ``screening.screen`` gives them. before: invoices that had arrived with earlier batches, to be held against for duplicates."""
    named = F.col("vendor_key") != ""
    parts = [
        screening.amount_findings(rows.where(named & F.col("total").isNotNull()), limits),
        screening.term_findings(rows.where(named & (F.col("terms_key") != "")).drop("n").withColumnRenamed("terms", "n"), limits),
        screening.round_numbers(rows, limits),
    ]
    if before is not None:
        both = rows.select(before.columns).withColumn("new", F.lit(True)).unionByName(before.withColumn("new", F.lit(False)))
        parts.append(screening.duplicates(both, limits, F.col("new")))
    return screening.placed(*parts)


LEDGER = {"invoices": GIVEN.removesuffix(", terms_key string"), "findings": "document_id string, anomaly_type string, severity string, score double, fingerprint string, reason string, evidence string"}


def screen_arrivals(invoices: DataFrame, ledger: Ledger, checkpoint: str, limits: screening.Limits = screening.Limits()):
    """Writes each batch's invoices and findings to ``ledger`` (tables ``LEDGER``) exactly once. Later batches are held against all invoices of earlier ones."""

    def tables(rows: DataFrame) -> dict[str, DataFrame]:
        before = ledger.read("invoices")
        return {"invoices": rows.select(before.columns), "findings": findings(rows, before, limits)}

    return ledger.write(with_history(invoices), checkpoint, tables)
