"""Tables that micro-batches are written to exactly once.

A batch's rows go to a folder of their own in each table, ``table/batch=n``, which a repeated batch writes anew; when all its tables are written one record of the batch is
appended to ``commits``. Readers see batches that have a record. So a batch that failed half-way is not seen, and one that is replayed after it was recorded changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

#: Keys by which the ledger's tables take no row twice.
KEYS = {"documents": ["file_hash"], "findings": ["document_id", "fingerprint"]}


class Ledger:
    """Append-only tables in one folder that driver and executors share. schemas: by table, as DDL. keys: by table, columns that tell a row that is there already; the first stays."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, list[str]] | None = None):
        self.spark, self.folder, self.schemas, self.keys = spark, folder.rstrip("/"), schemas, KEYS if keys is None else keys
        for name, schema in schemas.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{name}/batch=-1")
        spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{self.folder}/commits")

    def committed(self) -> DataFrame:
        return self.spark.read.schema("batch long").parquet(f"{self.folder}/commits").distinct()

    def read(self, name: str) -> DataFrame:
        """The rows of all recorded batches."""
        rows = self.spark.read.schema(f"{self.schemas[name]}, batch long").parquet(f"{self.folder}/{name}")
        return rows.join(self.committed(), "batch", "left_semi").drop("batch")

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Write a batch's rows; False if it was recorded before, which writes nothing."""
        if not self.committed().where(f"batch = {batch}").isEmpty():
            return False
        for name, rows in tables.items():
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            if keys := self.keys.get(name):
                rows = rows.dropDuplicates(keys).join(self.read(name).select(keys), keys, "left_anti")
            rows.select(columns).write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return True

    def write(self, stream: DataFrame, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> DataStreamWriter:
        """A stream whose batches become rows of tables, by ``tables``."""

        def each(rows: DataFrame, batch: int) -> None:
            rows = rows.persist()  # the tables are made from one run of the batch
            try:
                self.commit(batch, tables(rows))
            finally:
                rows.unpersist()

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
