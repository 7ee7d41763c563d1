"""As-of joins: to each event the fact that began last by then."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days whose events and facts of one key meet in one task.
DAYS = 90
#: Stands for the day of what always holds.
BEFORE_ALL = -(2**31)


def as_of(events: DataFrame, facts: DataFrame, keys: list[str], at: str, start: Column, values: list[str], tracks: dict[str, Column], days: int = DAYS) -> DataFrame:
    """Events with one struct of ``values`` for each track: the fact of their keys that began last on or before their day ``at``; null where none had begun.

    facts: ``start`` is their first day (null: always), ``tracks`` tells by name which facts belong to which column. Of facts that begin on one day the least, by ``values`` in order, counts. Events without a day
    meet only facts that always hold. Null keys are keys like others.

    Both sides are put into one order by union, and each event takes the last fact before it. A key's rows are parted by stretches of ``days``; what the stretches before
    leave comes from one row for each. So no key's rows meet in one task, and no event is multiplied.
    """
    first = F.coalesce(F.unix_date(start).cast("long"), F.lit(BEFORE_ALL).cast("long"))
    on = {f"on_{k}": F.col(k) for k in keys}
    fact = F.struct((-first).alias("later"), *values)  # of one day's the least
    left = events.select(*(c.alias(n) for n, c in on.items()), F.coalesce(F.unix_date(F.col(at)).cast("long"), F.lit(BEFORE_ALL).cast("long")).alias("day"), F.struct(*events.columns).alias("event"), *(F.lit(None).cast(_kind(facts, fact)).alias(f"fact_{t}") for t in tracks))
    right = facts.select(*(c.alias(n) for n, c in on.items()), first.alias("day"), F.lit(None).cast(left.schema["event"].dataType).alias("event"), *(F.when(c, fact).alias(f"fact_{t}") for t, c in tracks.items()))
    rows = left.unionByName(right).withColumn("stretch", F.floor(F.col("day") / days))
    ends = rows.where("event IS NULL").groupBy(*on, "stretch").agg(*(F.min(f"fact_{t}").alias(f"fact_{t}") for t in tracks))
    ends = ends.unionByName(rows.where("event IS NOT NULL").select(*on, "stretch", *(F.lit(None).cast(rows.schema[f"fact_{t}"].dataType).alias(f"fact_{t}") for t in tracks)).distinct())
    ends = ends.groupBy(*on, "stretch").agg(*(F.min(f"fact_{t}").alias(f"fact_{t}") for t in tracks))
    past = Window.partitionBy(*on).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*(F.col(n).alias(f"{n}_b") for n in on), F.col("stretch").alias("stretch_b"), *(F.min(f"fact_{t}").over(past).alias(f"before_{t}") for t in tracks))
    inside = Window.partitionBy(*on, "stretch").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # facts of the same day too
    found = rows.select(*on, "stretch", "event", *(F.min(f"fact_{t}").over(inside).alias(f"inside_{t}") for t in tracks)).where("event IS NOT NULL")
    found = found.join(before, reduce(and_, (F.col(n).eqNullSafe(F.col(f"{n}_b")) for n in on)) & (F.col("stretch") == F.col("stretch_b")))
    taken = {t: F.least(f"before_{t}", f"inside_{t}") for t in tracks}  # the least is the latest
    return found.select("event.*", *(F.when(c.isNotNull(), F.struct(*(c[v].alias(v) for v in values))).alias(t) for t, c in taken.items()))


def _kind(facts: DataFrame, fact: Column):
    return facts.select(fact.alias("fact")).schema["fact"].dataType
