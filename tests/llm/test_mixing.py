import math

import duckdb
from pyspark.sql import functions as F
from tallymill.llm import mixing

from .conftest import SF


def targets_by_hand(sizes, most=3):
    """Share by weight, stop what is above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        want = {s: target[s] + left * weight[s] / total for s in free}
        left = sum(max(0.0, want[s] - most * sizes[s]) for s in free)
        for s in free:
            target[s] = min(want[s], most * sizes[s])
        free = {s for s in free if target[s] < most * sizes[s]}
    return target


def test_targets_and_takings(spark, odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = targets_by_hand(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-3)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)


def test_agrees_with_sql_and_with_itself(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(map(tuple, mixing.mix(docs).collect()))
    again = sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert rows == again
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows == sorted(db.sql(mixing.ORACLE_SQL).fetchall())


def test_a_few_small_sources_stop_at_their_limit(spark, make_docs):
    docs = make_docs([(i, "a b c d", "en", "big") for i in range(20)] + [(100, "a b", "en", "c"), (101, "a", "en", "d"), (102, "", "en", "e")])
    rows = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert rows[100]["taken"] == 6 and rows[101]["taken"] == 3 and rows[102]["taken"] == 0
    assert sum(r["taken"] for i, r in rows.items() if i < 100) == 83 - 9


def test_the_mix_holds_what_was_taken(spark, odd_docs):
    taken = sum(r["taken"] for r in mixing.mix(odd_docs).dropDuplicates(["doc_id", "source", "size"]).collect())
    out = mixing.apply_mix(odd_docs.dropDuplicates(["doc_id", "source", "text"]))
    assert out.columns == odd_docs.columns
    assert abs(sum(len((r["text"] or "").split()) for r in out.collect()) - taken) < 40


def test_empty_and_clashing(spark, odd_docs):
    assert mixing.mix(odd_docs.limit(0)).collect() == []
    clash = odd_docs.withColumns({c: F.lit("x") for c in ("size", "taken", "part", "key", "target", "weight", "quality", "_text")})
    assert mixing.mix(clash).count() == odd_docs.count()
    names = ("size", "taken", "copy", "_copy", "_taken", "doc", "quality", "part", "key", "_text")
    clash = odd_docs.withColumns({c: F.lit("x") for c in names})
    out = mixing.apply_mix(clash)
    assert out.columns == clash.columns and {tuple(r[c] for c in names) for r in out.collect()} == {("x",) * len(names)}
    assert out.count() == mixing.apply_mix(odd_docs).count()


def test_many_sources_by_hand(spark):
    rows = [(f"s{i:03d}" if i else None, (i * 37) % 101 + 1) for i in range(300)]
    found = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long").repartition(3)).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    weight = {s: k % 3 + 1 for k, (s, _) in enumerate(ordered)}
    open_, want, spare = dict(rows), {}, sum(n for _, n in rows)
    while True:  # plain water filling
        total = sum(weight[s] for s in open_)
        over = [s for s, n in open_.items() if spare * weight[s] / total > 3 * n]
        if not over:
            break
        for s in over:
            want[s] = 3.0 * open_[s]
        spare -= sum(want[s] for s in over)
        for s in over:
            del open_[s]
    want |= {s: spare * weight[s] / sum(weight[x] for x in open_) for s in open_}
    assert all(abs(found[s] - want[s]) < 1e-6 for s in want) and len(found) == len(want)


def test_a_quality_column(spark, make_docs):
    docs = make_docs([(i, "a b c d e", "en", "s") for i in range(400)] + [(1000 + i, "a b", "en", "t") for i in range(900)]).withColumn("score", F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(0.1))
    rows = [r for r in mixing.mix(docs, quality=F.col("score")).collect() if r["source"] == "s"]
    assert sum(r["taken"] > 0 for r in rows if r["doc_id"] % 2 == 0) > 3 * max(1, sum(r["taken"] > 0 for r in rows if r["doc_id"] % 2))


def words(df):
    return sum(len((r["text"] or "").split()) for r in df.collect())


def test_equal_rows_take_their_own_parts(spark, make_docs):
    for n, other in ((100, 1000), (7, 50), (30, 4)):
        docs = make_docs([(1, "a b c d e f g h i j", "en", "x")] * n + [(2 + i, "w " * 10, "en", "y") for i in range(other // 10)] + [(None, "p q r", None, None)] * 5)
        taken = sum(r["taken"] for r in mixing.mix(docs).collect())
        assert words(mixing.apply_mix(docs)) == taken


def test_documents_without_quality_come_last(spark, make_docs):
    docs = make_docs([(i, "a b c d", "en", "x") for i in range(90)] + [(1000 + i, "k l m n", "en", "y") for i in range(90)])
    values = F.when(F.col("doc_id") % 3 == 0, F.lit(1.0)).when(F.col("doc_id") % 9 == 1, F.lit(None)).when(F.col("doc_id") % 9 == 2, F.lit(0.0)).when(F.col("doc_id") % 9 == 4, F.lit(float("nan"))).when(F.col("doc_id") % 9 == 5, F.lit(-2.0)).otherwise(F.lit(0.5))
    rows = mixing.mix(docs.withColumn("q", values.cast("double")), quality=F.col("q")).where("source = 'x'").collect()  # two thirds of its words are taken
    assert {r["taken"] for r in rows if r["doc_id"] % 9 in (0, 3, 6, 7, 8)} <= {4}
    assert sum(r["taken"] for r in rows) == 240
