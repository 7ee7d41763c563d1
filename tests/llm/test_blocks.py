"""Groups compared block by block: counts against a plain product, bins, and bytes shuffled against what is compared."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tallymill.llm.blocks import count_links

MEMBERS = "component long, wide boolean, bin long, blocks long, key long, copies long, payload binary"


def same_kind():
    def near(one, other):
        a, b = ([x.as_py()[0] for x in c] for c in (one, one if other is None else other))
        return np.equal.outer(np.array(a), np.array(b))

    return near


def shuffled(spark) -> int:
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def members(spark, m, size=2000, block=512):
    payload = F.concat(F.expr("cast(chr(65 + id % 5) as binary)"), *[F.unhex(F.sha2(F.concat_ws(":", "id", F.lit(k)).cast("binary"), 256)) for k in range(size // 32)])
    rows = spark.range(m).select(F.lit(1).cast("long"), F.lit(m > block), F.lit(0).cast("long"), F.lit(-(-m // block)).cast("long"), "id", F.lit(2).cast("long"), payload)
    return rows.toDF("component", "wide", "bin", "blocks", "key", "copies", "payload")


def test_bytes_shuffled_grow_with_the_classes(spark):
    took = {}
    for m in (512, 8192):
        before = shuffled(spark)
        counts, edges = count_links(members(spark, m), same_kind())
        found = {r["key"]: r["links"] for r in counts.collect()}
        took[m] = shuffled(spark) - before
        of = np.bincount(np.arange(m) % 5)
        assert found == {k: 2 * (int(of[k % 5]) - 1) for k in range(m)}
        assert edges.count() < 2 * m
    assert took[8192] < 1.2 * 16 * took[512], took


@pytest.mark.parametrize("blocks", [1, 3])
def test_neighbouring_bins_meet(spark, blocks):
    rows = [(c, True, k % 4, blocks, 100 * c + k, 1, b"x") for c in (1, 2) for k in range(40)]
    counts, edges = count_links(spark.createDataFrame(rows, MEMBERS), same_kind())
    for r in counts.collect():
        near = [k for k in range(40) if abs(k % 4 - r["key"] % 100 % 4) <= 1]
        assert r["links"] == len(near) - 1
    assert {r["src"] // 100 for r in edges.collect()} == {1, 2}


def test_nothing_to_compare(spark):
    counts, edges = count_links(spark.createDataFrame([], MEMBERS), same_kind())
    assert counts.collect() == [] and edges.collect() == []
    assert edges.schema["src"].dataType == T.LongType() and isinstance(pa.array([b"x"]), pa.BinaryArray)
