"""The capped, polled source of uploads."""

import hashlib
import os
import time

from pyspark.sql import functions as F
from tallymill.functions import clean
from tallymill.sources.polled import PIECE, Uploads


def put(folder, name, content, at=None):
    path = folder / name
    path.parent.mkdir(exist_ok=True, parents=True)
    path.write_bytes(content)
    if at:
        os.utime(path, (at, at))


def test_files_beyond_the_cap_are_not_read_whole(spark, tmp_path):
    spark.dataSource.register(Uploads)
    cap = 3 * PIECE
    for name, size in {"a.pdf": 10, "in/exact.pdf": cap, "over.pdf": cap + 1, "empty.pdf": 0, "b.txt": 5, "_SUCCESS": 0, ".hidden.pdf": 9}.items():
        put(tmp_path / "up", name, bytes(range(256)) * (size // 256) + b"x" * (size % 256))
    with open(tmp_path / "up" / "huge.PDF", "wb") as f:
        f.truncate(8 << 30)  # a hole: to read it whole would take long and fill a worker's memory
    began = time.time()
    rows = {os.path.basename(r["path"]): r for r in spark.read.format("uploads").option("suffixes", ".pdf").option("most_bytes", cap).load(str(tmp_path / "up")).collect()}
    assert time.time() - began < 60
    assert set(rows) == {"a.pdf", "exact.pdf", "over.pdf", "empty.pdf", "huge.PDF"}
    assert rows["huge.PDF"]["bytes_read"] <= cap + PIECE and rows["huge.PDF"]["length"] == 8 << 30
    assert [rows[n]["too_large"] for n in ("a.pdf", "exact.pdf", "over.pdf", "empty.pdf", "huge.PDF")] == [False, False, True, False, True]
    assert all((rows[n]["content"] is None) == rows[n]["too_large"] == (rows[n]["file_hash"] is None) for n in rows)
    assert rows["exact.pdf"]["file_hash"] == hashlib.sha256(bytes(range(256)) * (cap // 256)).hexdigest()
    df = spark.read.format("uploads").option("most_bytes", cap).option("files_a_task", 1).load(f"file://{tmp_path}/up")
    said = F.when(F.col("too_large"), "too_large").otherwise(clean.upload_verdict(F.col("content"), F.lit(None).cast("string"), cap))
    found = {r["name"]: r["v"] for r in df.select(clean.filename(F.col("path")).alias("name"), said.alias("v")).collect()}
    assert found == {"a.pdf": "unsupported", "exact.pdf": "unsupported", "over.pdf": "too_large", "empty.pdf": "empty", "b.txt": "unsupported", "huge.PDF": "too_large"}
    assert spark.read.format("uploads").load(str(tmp_path / "nowhere")).count() == 0


def test_polling_goes_on_after_a_restart(spark, tmp_path):
    spark.dataSource.register(Uploads)
    now = time.time() - 1000

    def poll():
        stream = spark.readStream.format("uploads").option("suffixes", ".txt").load(str(tmp_path / "in"))
        query = stream.drop("content").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        assert query.awaitTermination(120)
        return sorted(os.path.basename(r["path"]) for r in spark.read.schema("path string").parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", "a.txt", b"1", now)
    put(tmp_path / "in", "b.txt", b"2", now)
    put(tmp_path / "in", "c.pdf", b"3", now)
    assert poll() == ["a.txt", "b.txt"]
    assert poll() == ["a.txt", "b.txt"]
    put(tmp_path / "in", "bb.txt", b"4", now)  # of the same time, behind by name
    put(tmp_path / "in", "d.txt", b"5", now + 5)
    assert poll() == ["a.txt", "b.txt", "bb.txt", "d.txt"]
