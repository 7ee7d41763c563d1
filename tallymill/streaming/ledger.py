"""Structured Streaming forms of ingestion and of the rate limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.audit import TURNS


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """A stream of documents from Parquet files as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def first_of_each(stream: DataFrame, text: str = "text", watermark: str | None = None, at: str = "created_at") -> DataFrame:
    """Documents by content hash, the first of each. Without a watermark hashes are remembered for good, as the ledger does; with one, state is bounded and late copies pass."""
    hashed = stream.withColumn("file_hash", F.sha2(F.col(text).cast("binary"), 256))
    if watermark is None:
        return hashed.dropDuplicates(["file_hash"])
    return hashed.withWatermark(at, watermark).dropDuplicatesWithinWatermark(["file_hash"])


def request_rates(stream: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each client in tumbling windows of event time."""
    found = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "client").count()
    return found.select(F.col("window.start").alias("window_start"), "client", F.col("count").alias("n"))


#: How long a document may be without change before it counts as lost, and how long ended ones are remembered.
LOST_MS, KEPT_MS = 15 * 60 * 1000, 30 * 24 * 3600 * 1000
TURN = "document_id long, was string, status string, error_code string, seq long"


class _Document(StatefulProcessor):
    """A document's state. Only a change that is applied gives a row: of two that want the same, the first wins and the other, or a replay, gives none.

    A request that its state doesn't allow yet waits for an earlier one that is still under way, and is dropped when the state has moved past it.
    """

    def __init__(self, lost_ms: int, kept_ms: int):
        self.lost_ms, self.kept_ms = lost_ms, kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "status string, seq long", self.kept_ms)
        self.waiting = handle.getListState("waiting", "seq long, wanted string", self.kept_ms)

    def _rows(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["document_id", "was", "status", "error_code", "seq"]).astype({"seq": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, last = self.now.get() if self.now.exists() else ("PENDING", -1)
        wanted = {(int(s), w) for batch in rows for s, w in zip(batch["seq"], batch["wanted"], strict=True)} | set(self.waiting.get() if self.waiting.exists() else ())
        out = []
        for seq, want in sorted(wanted):
            if want in TURNS.get(now, ()) and seq > last:
                out.append((key[0], now, want, None, seq))
                now, last = want, seq
        early = [(s, w) for s, w in sorted(wanted) if s > last and now == "PENDING" and w in TURNS["PROCESSING"]]
        self.waiting.put(early) if early else self.waiting.clear()
        self.now.update((now, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now in TURNS:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.lost_ms)
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, last = self.now.get() if self.now.exists() else ("PENDING", -1)
        if now in TURNS:
            self.now.update(("FAILED", last))
            self.waiting.clear()
            yield from self._rows([(key[0], now, "FAILED", "worker_lost", None)])

    def close(self) -> None:
        pass


def state_machine(stream: DataFrame, lost_ms: int = LOST_MS, kept_ms: int = KEPT_MS) -> DataFrame:
    """Allowed changes of documents' states from requests (document_id, seq, wanted), one row each; those untouched for ``lost_ms`` fail. Needs the state store of ``STORE``."""
    return stream.groupBy("document_id").transformWithStateInPandas(_Document(lost_ms, kept_ms), TURN, "Append", "ProcessingTime")
