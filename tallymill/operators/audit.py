"""What the append-only log tells: stages' states, lost workers, decisions, retries, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import as_of

# The stages in order, the events that complete them, and the states a document may turn to.
STAGES = ["ingest", "route", "extract", "validate", "screen", "ledger"]
COMPLETES = {
    "document.received": ("ingest", "passed"), "document.deduplicated": ("ingest", "passed"), "pipeline.routed": ("route", "passed"), "pipeline.extraction_succeeded": ("extract", "passed"),
    "pipeline.validation_passed": ("validate", "passed"), "pipeline.validation_failed": ("validate", "flagged"), "pipeline.screening_completed": ("screen", "passed"), "ledger.committed": ("ledger", "passed"),
}
TURNS = {"PENDING": ["PROCESSING", "FAILED"], "PROCESSING": ["DONE", "NEEDS_REVIEW", "FAILED"]}


def _lookup(event: Column, which: int) -> Column:
    out = F.lit(None).cast("string")
    for name, pair in COMPLETES.items():
        out = F.when(event == name, pair[which]).otherwise(out)
    return out


def stage_projection(log: DataFrame) -> DataFrame:
    """One row a document: the state of each of six stages, when it was last touched, and progress.

    The last completion of a stage tells its state; a raised anomaly flags a passed screening; the last
    failure fails its stage and sets later ones back to pending. Then progress is the share of passed and flagged stages, and while nothing
    failed and the ledger isn't reached the first pending stage is active. One aggregation, no join.
    """
    e = log.withColumns({"of": _lookup(F.col("event"), 0), "to": _lookup(F.col("event"), 1)})
    failed = F.col("event") == "job.failed"
    fail_stage = F.when(F.col("stage").isin(STAGES), F.col("stage")).otherwise("ingest")
    last = [F.max_by("to", F.when(F.col("of") == s, F.col("id"))).alias(f"last_{s}") for s in STAGES]
    times = [F.max_by("created_at", F.when((F.col("of") == s) | (failed & (fail_stage == s)), F.col("id"))).alias(f"{s}_at") for s in STAGES]
    d = e.groupBy("document_id").agg(*last, *times, F.max(F.when(F.col("event") == "pipeline.anomaly_raised", 1).otherwise(0)).alias("raised"), F.max_by(fail_stage, F.when(failed, F.col("id"))).alias("failed_stage"))
    at = F.array_position(F.array(*map(F.lit, STAGES)), F.col("failed_stage"))
    for k, s in enumerate(STAGES, 1):
        state = F.coalesce(f"last_{s}", F.lit("pending"))
        if s == "screen":
            state = F.when((F.col("raised") == 1) & (state == "passed"), "flagged").otherwise(state)
        d = d.withColumn(s, F.when(F.col("failed_stage").isNull() | (F.lit(k) < at), state).when(F.lit(k) == at, "failed").otherwise("pending"))
    done = sum((F.when(F.col(s).isin("passed", "flagged"), 1).otherwise(0) for s in STAGES), F.lit(0))
    d = d.withColumn("progress", F.round(done / 6, 4))
    running = F.col("failed_stage").isNull() & (F.col("ledger") == "pending")
    first = F.coalesce(*(F.when(F.col(s) == "pending", s) for s in STAGES))
    d = d.withColumn("active_stage", F.when(running, first))
    return d.select("document_id", *(F.when(F.col("active_stage") == s, "active").otherwise(F.col(s)).alias(s) for s in STAGES), *(f"{s}_at" for s in STAGES), "progress")


def stale(documents: DataFrame, now: Column, seconds: int = 900) -> DataFrame:
    """Documents not ended and not touched for so long: they fail, with a job for the dead letters."""
    lost = documents.where(F.col("status").isin("PENDING", "PROCESSING") & (F.unix_timestamp("updated_at") < F.unix_timestamp(now) - seconds))
    return lost.select("document_id", F.col("status").alias("was"), F.lit("FAILED").alias("status"), F.lit("worker_lost").alias("error_code"))


def first_resolution(decisions: DataFrame) -> DataFrame:
    """The first decision on each finding is accepted, later ones are refused."""
    order = Window.partitionBy("anomaly_id").orderBy("decided_at", "decision_id")
    return decisions.withColumn("accepted", F.row_number().over(order) == 1)


def turns(requests: DataFrame) -> DataFrame:
    """Requested states in order, each applied if the state before it allows: the fold of one document's requests."""
    ordered = requests.groupBy("document_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "wanted"))), lambda r: r["wanted"]).alias("wanted"))

    def apply(state: Column, want: Column) -> Column:
        allowed = F.lit(False)
        for source, targets in TURNS.items():
            allowed = allowed | ((state == source) & want.isin(targets))
        return F.when(allowed, want).otherwise(state)

    return ordered.select("document_id", F.aggregate("wanted", F.lit("PENDING"), apply).alias("status"), F.size("wanted").alias("requests"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of each document's attempts with a valid schema, up to the first that passes, the one with fewest failures; later ones win ties."""
    first_pass = Window.partitionBy("document_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    tried = attempts.withColumn("done", F.max(F.when(F.col("schema_valid") & (F.col("failures") == 0), 1).otherwise(0)).over(first_pass)).where("coalesce(done, 0) = 0")
    return tried.groupBy("document_id").agg(F.min_by(F.col("attempt"), F.when(F.col("schema_valid"), F.struct("failures", -F.col("attempt")))).alias("attempt"), F.count(F.lit(1)).alias("tried"))


def over_limit(requests: DataFrame, limit: int, width: str = "1 minute") -> DataFrame:
    """Clients with more than ``limit`` requests in one tumbling window."""
    found = requests.groupBy(F.window("ts", width), "client").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return found.select(F.col("window.start").alias("window_start"), "client", "n")


#: Requests a client may send in one window, by class.
RATES = {"upload": 10, "mutation": 60, "read": 600}


def over_rates(requests: DataFrame, rates: dict[str, int] = RATES, width: str = "1 minute") -> DataFrame:
    """Clients beyond the limit of a class of requests in one tumbling window; a class without limit is never over."""
    limit = F.create_map(*(F.lit(x) for pair in rates.items() for x in pair))[F.col("kind")]
    found = requests.groupBy(F.window("ts", width), "client", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return found.select(F.col("window.start").alias("window_start"), "client", "kind", "n")


def priced(traces: DataFrame, prices: DataFrame, fallback: tuple[float, float] = (3.0, 15.0)) -> DataFrame:
    """Calls with their cost, one row a call: the promotional price that began last and hasn't ended, else the standing one that began last, else the fallback.

    ``prices``: model, price_in, price_out (USD a million tokens), valid_to (the last day; null: standing) and perhaps valid_from (the first day). A promotion without first day begins where
    the one that ends before it ended; prices alike in model and days count once, the least. Any number of prices a model.
    """
    given = prices if "valid_from" in prices.columns else prices.withColumn("valid_from", F.lit(None).cast("date"))
    promotion = F.col("valid_to").isNotNull()
    ended = F.lag("valid_to").over(Window.partitionBy("model", promotion).orderBy("valid_to", "valid_from", "price_in", "price_out"))
    given = given.withColumn("begins", F.coalesce("valid_from", F.when(promotion, F.date_add(ended, 1))))
    both = as_of(traces, given, ["model"], "called_on", F.col("begins"), ["valid_to", "price_in", "price_out"], {"promo": promotion, "standing": ~promotion})
    on = F.col("called_on") <= F.col("promo.valid_to")
    price_in, price_out = (F.coalesce(F.when(on, F.col(f"promo.price_{d}")), F.col(f"standing.price_{d}"), F.lit(fallback[k])) for k, d in enumerate(("in", "out")))
    return both.select(*traces.columns, F.round((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6, 6).alias("cost_usd"))


def insert_if_absent(arrivals: DataFrame, ledger: DataFrame | None, key: str = "file_hash", order: str = "seq") -> DataFrame:
    """The first arrival of each key that the ledger hasn't got. Map-side minima go before the shuffle, so a key with most of the rows is no hot spot."""
    firsts = arrivals.groupBy(key).agg(F.min(order).alias(order))
    found = arrivals.join(firsts, [key, order], "left_semi")
    return found if ledger is None else found.join(ledger.select(key), key, "left_anti")
