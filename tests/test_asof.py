"""As-of joins against DuckDB's own, and prices against a loop."""

import random
from datetime import date, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F
from tallymill.operators import audit, screening
from tallymill.operators.asof import as_of

DAY = date(2026, 1, 1)


@pytest.mark.parametrize("days", [1, 30, 100_000])
def test_agrees_with_asof_of_duckdb(spark, days):
    rng = random.Random(days)
    events = [(i, rng.choice(["a", "b", "hot", None]) if i % 3 else "hot", DAY + timedelta(rng.randrange(300))) for i in range(400)]
    facts = sorted({(rng.choice(["a", "hot", "hot", "c"]), DAY + timedelta(rng.randrange(-50, 320))) for _ in range(120)})
    facts = [(k, d, j) for j, (k, d) in enumerate(facts)]
    e, f = spark.createDataFrame(events, "id long, key string, day date"), spark.createDataFrame(facts, "key string, began date, fact long")
    found = as_of(e, f, ["key"], "day", F.col("began"), ["fact"], {"latest": F.lit(True)}, days)
    got = {(r["id"], r["key"], r["day"], r["latest"] and r["latest"]["fact"]) for r in found.collect()}
    db = duckdb.connect()
    db.sql("CREATE TABLE e (id BIGINT, key VARCHAR, day DATE)"), db.sql("CREATE TABLE f (key VARCHAR, began DATE, fact BIGINT)")
    db.executemany("INSERT INTO e VALUES (?, ?, ?)", events), db.executemany("INSERT INTO f VALUES (?, ?, ?)", facts)
    assert got == set(db.sql("SELECT e.id, e.key, e.day, f.fact FROM e ASOF LEFT JOIN f ON e.key = f.key AND e.day >= f.began").fetchall())
    assert found.count() == len(events)


def test_prices_of_any_number(spark):
    rng = random.Random(4)
    prices = [("m", float(i), 2.0 * i, None if i % 4 == 0 else DAY + timedelta(rng.randrange(20, 200)), None if i in (0, 5, 9) else DAY + timedelta(rng.randrange(150))) for i in range(14)]
    prices += [("two", 1.0, 1.0, None, None), ("two", 2.0, 1.0, None, None), (None, 7.0, 7.0, None, None)]
    calls = [(i, rng.choice(["m", "m", "two", "unknown", None]), DAY + timedelta(rng.randrange(260)), 1_000_000, 1_000_000) for i in range(200)] + [(900, "m", None, 1, 1)]
    rows = audit.priced(spark.createDataFrame(calls, "id long, model string, called_on date, input_tokens long, output_tokens long"), spark.createDataFrame(prices, "model string, price_in double, price_out double, valid_to date, valid_from date")).collect()
    assert sorted(r["id"] for r in rows) == [c[0] for c in calls]
    promos = sorted((p for p in prices if p[3]), key=lambda p: (p[3], p[4] or date.min, p[1]))
    begun = [(p[4] or (promos[i - 1][3] + timedelta(1) if i else date.min), p) for i, p in enumerate(promos)]
    standing = [(p[4] or date.min, p) for p in prices if not p[3]]
    for r in rows:
        day = r["called_on"] or date.min
        latest = lambda some: min((x for x in some if x[0] <= day and x[1][0] == r["model"]), key=lambda x: ((day - x[0]).days, x[1][3] or day, x[1][1]), default=None)  # noqa: B023, E731
        promo, own = latest(begun), latest(standing)
        price = promo[1][1:3] if promo and r["called_on"] and r["called_on"] <= promo[1][3] else own[1][1:3] if own else (3.0, 15.0)
        assert abs(r["cost_usd"] - (r["input_tokens"] * price[0] + r["output_tokens"] * price[1]) / 1e6) < 1e-6


def test_history_keeps_rows_without_key_or_place(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (2, 2, "a"), (3, None, "a"), (4, 4, None), (5, 5, None), (6, None, None)], "id int, ingest_seq long, k string")
    found = {r["id"]: r["n"] for r in screening.earlier(rows, ["k"], {"n": F.lit(1)}).collect()}
    assert found == {3: None, 1: 1, 2: 2, 6: None, 4: 1, 5: 2}
