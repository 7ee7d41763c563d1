"""Screening of invoices against those that had arrived before them.

History is what arrived earlier (ingest_seq), whatever its dates. A vendor whose key is empty has no history of its own and takes part in no
comparison. A finding has a reason, a sentence whose form is fixed, and its evidence as JSON.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import terms_key, vendor_key
from ..sources.tables import written
from . import names
from .stats import severity_rank


# What findings say, as stored; %s stands for the values.
SENTENCES = {
    "duplicate": "Possible duplicate payment: %s was already billed %s %s on %s, and this invoice bills %s on %s — %s%% apart, %s, %s.",
    "later": "%s day(s) later",
    "earlier": "%s day(s) earlier",
    "same day": "the same day",
    "same number": "under the same invoice number %s",
    "other number": "under a different invoice number (%s vs %s)",
    "no number": "none",
    "steady": "Amount is %sx this vendor's usual invoice: %s normally bills close to %s %s (the last %s invoices vary by under 1%%), but this one is %s.",
    "spread": "Amount is %s standard deviations %s than normal for %s: this invoice is %s %s against an average of %s across %s prior invoices (%sx the usual).",
    "above": "higher",
    "below": "lower",
    "terms": 'Payment terms changed for %s: this invoice says "%s", but %s of the last %s invoices from this vendor used "%s".',
    "round": "Total is an exactly round %s %s — a whole multiple of %s. Itemised invoices with tax rarely land on a round figure, which is typical of an estimate or a placeholder amount.",
}


@dataclass(frozen=True)
class Limits:
    """When the detectors fire."""

    similarity: float = 88.0
    gap: str = "0.01"
    days: int = 7
    z: float = 2.0
    z_high: float = 3.0
    history: int = 4
    least_spread: float = 0.01
    terms_history: int = 3
    terms_share: float = 0.7
    round_least: int = 500


#: What detectors read of an invoice.
READ = ["document_id", "ingest_seq", "vendor", "invoice_number", "issue_date", "total", "currency", "payment_terms", "filename"]


def prepared(invoices: DataFrame) -> DataFrame:
    """What detectors read, with keys, as a written table: the source is read once and its names are cleaned once, for all of them."""
    return _told_apart(written(keyed(_with_extras(invoices).select(READ)), "invoices"))


#: Into so many parts vendors' keys are dealt to be counted.
PARTS = 1 << 16


def _told_apart(rows: DataFrame) -> DataFrame:
    """Rows with ``crowded``: whether their vendor may have more than ``STRETCH`` of them. Keys are counted by parts of their hashes, so little is shuffled, and no more full parts are named than there are stretches of rows."""
    part = F.pmod(F.xxhash64("vendor_key"), F.lit(PARTS))
    full = [r["part"] for r in rows.where("vendor_key <> ''").groupBy(part.alias("part")).count().where(F.col("count") > STRETCH).collect()]
    return rows.withColumn("crowded", part.isin(full) if full else F.lit(False))


def keyed(invoices: DataFrame) -> DataFrame:
    return invoices.withColumns({"vendor_key": vendor_key(F.col("vendor")), "terms_key": terms_key(F.col("payment_terms"))})


#: Arrivals that are summed in one task for one key; a key with more is parted by their order.
STRETCH = 100_000


def earlier(rows: DataFrame, keys: list[str], sums: dict[str, Column], greatest: dict[str, Column] | None = None) -> DataFrame:
    """Rows with sums (and greatest values) over the rows of equal keys that had arrived before, null where there are none.

    A key's rows are parted by stretches of ``ingest_seq``: windows run within a stretch, and what the stretches before hold comes
    from one row for each. So no key's rows meet in one task, however many it has. A null key is one like others; rows without ``ingest_seq`` came first, in any order.
    """
    named = {n: (c, F.sum) for n, c in sums.items()} | {n: (c, F.max) for n, c in (greatest or {}).items()}
    parted = rows.select("*", F.floor(F.col("ingest_seq") / STRETCH).alias("stretch_"), *(c.alias(f"{n}_") for n, (c, _) in named.items()))
    whole = parted.groupBy(*keys, "stretch_").agg(*(f(f"{n}_").alias(f"{n}_") for n, (_, f) in named.items()))
    over = Window.partitionBy(*keys).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    on = [*keys, "stretch_"]
    before = whole.select(*(F.col(c).alias(f"on_{c}") for c in on), *(f(f"{n}_").over(over).alias(f"{n}_before_") for n, (_, f) in named.items()))
    inside = Window.partitionBy(*keys, "stretch_").orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, -1)
    found = parted.select("*", *(f(f"{n}_").over(inside).alias(f"{n}_inside_") for n, (_, f) in named.items()))
    found = found.join(before, reduce(and_, (F.col(c).eqNullSafe(F.col(f"on_{c}")) for c in on)))
    both = {n: (F.coalesce(F.col(f"{n}_before_") + F.col(f"{n}_inside_"), f"{n}_before_", f"{n}_inside_") if f is F.sum else F.greatest(f"{n}_before_", f"{n}_inside_")) for n, (_, f) in named.items()}
    return found.select(*rows.columns, *(c.alias(n) for n, c in both.items()))


def _within(rows: DataFrame, keys: list[str], sums: dict[str, Column], greatest: dict[str, Column] | None = None) -> DataFrame:
    """What ``earlier`` gives, for keys that have no more than ``STRETCH`` rows: windows alone, so rows are dealt once."""
    over = Window.partitionBy(*keys).orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("*", *(F.sum(c).over(over).alias(n) for n, c in sums.items()), *(F.max(c).over(over).alias(n) for n, c in (greatest or {}).items()))


def _by_vendor(rows: DataFrame, step: Callable[[DataFrame, Callable[..., DataFrame]], DataFrame]) -> DataFrame:
    """``step`` of rows with a way to know what came before: vendors' rows meet in one task, from the first to the last step, but for crowded vendors, which are parted."""
    return step(rows.where("not crowded").repartition("vendor_key"), _within).unionByName(step(rows.where("crowded"), earlier))


def history(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per invoice, how many earlier ones any detector could need: by_vendor (their vendor's name holds the first token of its key), by_date (issued within the window), by_both, n (either).

    An invoice with neither key nor date needs none. Nothing is paired: an earlier invoice counts under each token that its vendor's name
    holds, found once for each distinct name in its runs of letters and digits, and under each day in reach of its date.
    """
    k = keyed(invoices).select("document_id", "ingest_seq", F.lower("vendor").alias("name"), F.split("vendor_key", " ")[0].alias("token"), F.datediff("issue_date", F.lit("1970-01-01").cast("date")).alias("day"))
    k = written(k, "history")
    tokens = k.where("token <> ''").select(F.col("token").alias("held")).distinct()
    lengths = tokens.agg(F.collect_set(F.length("held")).alias("lengths"))  # a handful of small numbers
    names = k.where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(lengths))
    runs = names.select("name", "rows", "lengths", F.explode(F.array_distinct(F.split("name", "[^a-z0-9]+"))).alias("run"))  # a token lies within one
    starts = lambda n: F.when(F.length("run") >= n, F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda at: F.substring("run", at, n))).otherwise(F.array().cast("array<string>"))
    parts = runs.select("name", "rows", F.explode(F.array_distinct(F.flatten(F.transform("lengths", starts)))).alias("held"))
    held = written(parts.join(tokens, "held").groupBy("name", "held").agg(F.max("rows").alias("rows")), "held")
    crowded = held.groupBy("held").agg(F.sum("rows").alias("rows")).where(F.col("rows") > STRETCH).select("held", F.lit(True).alias("crowded"))  # one for each STRETCH rows at most
    vendors = k.join(held.select("name", "held"), "name").join(F.broadcast(crowded), "held", "left").na.fill(False, ["crowded"])  # each row under each token that its name holds, its own among them
    vendors = vendors.select("document_id", "ingest_seq", "day", "held", "crowded", (F.col("held") == F.col("token")).alias("own"))
    by_vendor = _counted(vendors, ["held"], limits.days, STRETCH).select("document_id", F.col("n").alias("by_vendor"), F.col("near").alias("by_both"))
    by_date = _counted(k.select("document_id", "ingest_seq", "day", F.lit(True).alias("crowded"), F.lit(True).alias("own")), [], limits.days, max(1, STRETCH // 4)).select("document_id", F.col("near").alias("by_date"))
    found = by_date.join(by_vendor, "document_id", "left").na.fill(0, ["by_vendor", "by_both"]).select("document_id", "by_vendor", "by_date", "by_both")
    return found.withColumn("n", F.col("by_vendor") + F.col("by_date") - F.col("by_both"))


def _counted(rows: DataFrame, keys: list[str], reach: int, stretch: int) -> DataFrame:
    """Those ``own`` rows with how many of equal keys had arrived before (n, if there are keys) and how many of these lie ``reach`` days away at most (near).

    Rows are dealt once, by keys, and only then set under each day in reach, within their task. Keys that are ``crowded`` are parted by stretches of ``ingest_seq`` besides;
    what their earlier stretches hold joins the rows as sums that come first.
    """
    one, on = F.lit(1).cast("long"), lambda day: F.sequence(day - reach, day + reach)
    parted = rows.withColumn("stretch_", F.when(F.col("crowded"), F.floor(F.col("ingest_seq") / stretch)))
    whole = parted.where("crowded").groupBy(*keys, "stretch_", "day").agg(F.count(F.lit(1)).alias("n_"))
    before = lambda *by: Window.partitionBy(*by).orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    under = whole.where("day is not null").select(*keys, "stretch_", "day", "n_", F.explode(on(F.col("day"))).alias("on_"))
    under = under.groupBy(*keys, "stretch_", "on_").agg(F.sum("n_").alias("n_"), F.max(F.col("day") == F.col("on_")).alias("asked_"))
    sums = under.withColumn("near_", F.sum("n_").over(before(*keys, "on_"))).where("asked_ and near_ > 0").select(*keys, "stretch_", F.array("on_").alias("ons_"), "near_")
    if keys:
        totals = whole.groupBy(*keys, "stretch_").agg(F.sum("n_").alias("n_")).withColumn("all_", F.sum("n_").over(before(*keys))).where("all_ > 0")
        sums = sums.unionByName(totals.select(*keys, "stretch_", "all_"), allowMissingColumns=True)
    every = parted.drop("crowded").withColumns({"ons_": on(F.col("day")), "near_": one, "all_": one}).unionByName(sums, allowMissingColumns=True).repartition(*keys, "stretch_")
    inside = lambda *by: Window.partitionBy(*keys, "stretch_", *by).orderBy("ingest_seq").rowsBetween(Window.unboundedPreceding, -1)
    every = every.withColumn("n", F.coalesce(F.sum("all_").over(inside()), F.lit(0))) if keys else every
    spread = every.select("*", F.explode_outer("ons_").alias("on_")).withColumn("near", F.coalesce(F.sum("near_").over(inside("on_")), F.lit(0)))
    found = spread.where("own and on_ <=> day").withColumn("near", F.when(F.col("day").isNotNull(), F.col("near")).otherwise(0))
    return found.select("document_id", *(["n"] if keys else []), "near")


def similar_names(asked: DataFrame, others: DataFrame, least: float = 88.0) -> DataFrame:
    """a, b, ratio for each asked name (a, name_a) and other name (b, name_b) with a ratio of ``least`` or more; equal names are alike."""
    keys = others.select(F.col("name_b").alias("key"), F.lit(False).alias("asked")).union(asked.select("name_a", F.lit(True))).where("key is not null").groupBy("key").agg(F.max("asked").alias("asked"))
    alike = names.similar(keys, least).union(keys.where("asked and trim(key) <> ''").select("key", F.col("key").alias("other"), F.lit(100.0).alias("similarity")))
    found = asked.join(alike, F.col("name_a") == F.col("key")).join(others, F.col("other") == F.col("name_b")).where("a <> b")
    return found.select("a", "b", F.round("similarity", 4).alias("ratio"))


def duplicates(invoices: DataFrame, limits: Limits = Limits(), asked: Column | None = None) -> DataFrame:
    """One row for each earlier invoice that a document seems to repeat; of documents for which ``asked`` holds, if it is given.

    A band join: the other vendor's key, signs, bins of days and bins of the logarithm of the amount are equality keys, exact conditions follow. Which
    keys are similar is worked out once for the distinct ones (``names.similar``), so one usual price on one day pairs no vendors that aren't.
    """
    new = F.lit(True) if asked is None else asked
    return _duplicates(_told_apart(written(keyed(_with_extras(invoices).withColumn("new", new).select(*READ, "new")), "invoices")), limits)


def _duplicates(prepared: DataFrame, limits: Limits) -> DataFrame:
    # bins some times as wide as what is looked for, so that most rows look into one of each
    reach = -math.log(1 - float(limits.gap)) + 1e-6
    step = max(0.05, 2.5 * reach)
    total = F.col("total").cast("double")
    sides = prepared.where("vendor_key <> '' and issue_date is not null and total is not null")
    sides = sides.withColumns({"sign": F.signum("total").cast("int"), "amount_bin": F.when(total == 0, F.lit(0)).otherwise(F.floor(F.ln(F.abs(total)) / step))})
    width, origin = 4 * (limits.days + 1), F.lit("1970-01-01").cast("date")
    day = F.datediff("issue_date", origin)
    asked = lambda rows: rows.where("new") if "new" in rows.columns else rows

    def met(looks: DataFrame, others: DataFrame) -> DataFrame:
        looks = looks.withColumn("day_bin", F.explode(F.sequence(F.floor((day - limits.days) / width), F.floor((day + limits.days) / width))))
        looks = looks.withColumn("amount_bin", F.explode(F.when(F.col("sign") == 0, F.array("amount_bin")).otherwise(F.sequence(F.floor((F.ln(F.abs(total)) - reach) / step), F.floor((F.ln(F.abs(total)) + reach) / step)))))
        prior = others.select(*(F.col(x).alias(f"prior_{x}") for x in ("document_id", "ingest_seq", "vendor_key", "issue_date", "total", "currency", "invoice_number", "filename")), "sign", "amount_bin", F.floor(day / width).alias("day_bin"))
        return looks.join(prior, ["prior_vendor_key", "day_bin", "sign", "amount_bin"]).where(near)

    gap, largest = F.abs(F.col("total") - F.col("prior_total")), F.greatest(F.abs("total"), F.abs("prior_total"))
    near = (
        (F.col("prior_ingest_seq") < F.col("ingest_seq"))
        & (F.abs(F.datediff("issue_date", "prior_issue_date")) <= limits.days)
        & (gap <= F.lit(limits.gap).cast("decimal(4,2)") * largest)
        & ((F.col("currency") == F.col("prior_currency")) | (F.coalesce("currency", F.lit("")) == "") | (F.coalesce("prior_currency", F.lit("")) == ""))
    )
    # a row that no other of its vendor is near in days is in no pair of equal keys; the rest are few, and only they are dealt by bins
    beside = Window.partitionBy("vendor_key", "sign").orderBy("day")
    calm = sides.where("not crowded").repartition("vendor_key").withColumn("day", day)
    calm = calm.withColumn("away", F.least(F.col("day") - F.lag("day").over(beside), F.lead("day").over(beside) - F.col("day"))).where(F.col("away") <= limits.days).drop("day", "away")
    own = written(calm, "near").unionByName(sides.where("crowded"))
    found = met(asked(own).withColumns({"prior_vendor_key": F.col("vendor_key"), "similarity": F.lit(100.0)}), own)  # a key is like itself, which takes no join
    if limits.similarity < 100:
        alike = names.similar(sides.select(F.col("vendor_key").alias("key")).distinct(), limits.similarity).select(F.col("key").alias("vendor_key"), F.col("other").alias("prior_vendor_key"), "similarity")
        alike = written(alike, "alike")
        found = found.unionByName(met(asked(sides).join(alike, "vendor_key"), sides.join(alike.select("vendor_key").distinct(), "vendor_key", "left_semi")))
    days = F.datediff("issue_date", "prior_issue_date")
    share = F.coalesce(F.try_divide(100 * gap.cast("double"), largest.cast("double")), F.lit(0.0))
    number, prior_number = F.col("invoice_number"), F.col("prior_invoice_number")
    same_number = F.coalesce(F.lower(F.trim(number)) == F.lower(F.trim(prior_number)), F.lit(False))
    when = F.when(days > 0, _said("later", days)).when(days < 0, _said("earlier", -days)).otherwise(SENTENCES["same day"])
    none = F.lit(SENTENCES["no number"])
    numbers = F.when(same_number, _said("same number", number)).otherwise(_said("other number", F.coalesce(number, none), F.coalesce(prior_number, none)))
    reason = _said("duplicate", F.col("vendor"), _amount("prior_total"), F.coalesce("prior_currency", F.lit("")), F.col("prior_issue_date").cast("string"), _amount("total"), F.col("issue_date").cast("string"), F.format_string("%.2f", share), when, numbers)
    evidence = F.struct(
        F.col("prior_document_id").cast("string").alias("matched_document_id"), F.col("prior_filename").alias("matched_filename"), prior_number.alias("matched_invoice_number"), F.col("prior_total").cast("double").alias("matched_total"), F.col("prior_issue_date").cast("string").alias("matched_issue_date"), total.alias("candidate_total"),
        F.col("issue_date").cast("string").alias("candidate_issue_date"), F.col("similarity").alias("vendor_similarity"), share.alias("amount_gap_pct"), F.abs(days).alias("day_gap"), days.alias("day_delta"), same_number.alias("same_invoice_number"),
    )
    return found.select(
        "document_id", F.col("prior_document_id").alias("prior_id"), F.lit("duplicate").alias("anomaly_type"), F.lit("HIGH").alias("severity"), F.round("similarity", 4).alias("score"),
        F.concat(F.lit("duplicate:"), F.col("prior_document_id").cast("string")).alias("fingerprint"), reason.alias("reason"), F.to_json(evidence, _NULLS).alias("evidence"),
    )


_NULLS = {"ignoreNullFields": "false"}


def _with_extras(invoices: DataFrame) -> DataFrame:
    """Invoices with the columns that only reasons name, null where the ledger has none."""
    return invoices.withColumns({c: F.lit(None).cast("string") for c in ("invoice_number", "filename") if c not in invoices.columns})


def _amount(column: str) -> Column:
    return F.format_number(F.bround(F.col(column), 2), 2)


def _said(sentence: str, *values: Column) -> Column:
    """One of ``SENTENCES``, without two spaces where a currency is missing."""
    return F.replace(F.format_string(SENTENCES[sentence], *values), F.lit("  "), F.lit(" "))


def amount_zscores(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Totals far from the mean of the vendor's earlier ones, from exact sums of what came before."""
    return _amount_zscores(prepared(invoices), limits)


def _amount_zscores(prepared: DataFrame, limits: Limits) -> DataFrame:
    exact = F.col("total").cast("decimal(14,2)")
    k = prepared.where("vendor_key <> '' and total is not null")
    w = _by_vendor(k, lambda rows, before: before(rows, ["vendor_key"], {"n": F.lit(1).cast("long"), "s1": exact, "s2": (exact * exact).cast("decimal(38,4)")}, {"high": exact, "low": -exact}))
    return amount_findings(w, limits)


def amount_findings(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same from invoices with what their vendors' earlier totals come to: n, s1, s2 (sums of totals and of their squares), high, low (the least, negated)."""
    total = F.col("total").cast("double")
    w = rows.where(F.col("n") >= limits.history)
    s1, s2 = F.col("s1").cast("double"), F.col("s2").cast("double")
    w = w.withColumns({"mean": F.try_divide(s1, F.col("n")), "sd": F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("n") * s2 - s1 * s1, F.col("n") * (F.col("n") - 1))))}).where(F.col("mean") != 0)
    floor = limits.least_spread * F.abs("mean")
    w = w.withColumn("z", F.try_divide(total - F.col("mean"), F.greatest("sd", floor))).where(F.abs("z") > limits.z)
    times, floored, currency = F.format_string("%.1f", F.try_divide(total, F.col("mean"))), F.col("sd") < floor, F.coalesce("currency", F.lit(""))
    n = F.col("n").cast("string")
    steady = _said("steady", times, F.col("vendor"), F.format_number("mean", 2), currency, n, _amount("total"))
    spread = _said("spread", F.format_string("%.1f", F.abs("z")), F.when(F.col("z") > 0, SENTENCES["above"]).otherwise(SENTENCES["below"]), F.col("vendor"), _amount("total"), currency, F.format_number("mean", 2), n, times)
    evidence = F.struct(
        "vendor_key", total.alias("candidate_total"), F.col("n").alias("history_count"), F.round("mean", 2).alias("history_mean"), F.round(F.greatest("sd", floor), 2).alias("history_std"), F.round("sd", 2).alias("history_std_observed"), floored.alias("dispersion_floored"),
        (-F.col("low")).cast("double").alias("history_min"), F.col("high").cast("double").alias("history_max"), F.round("z", 4).alias("zscore"), F.lit(limits.z).alias("threshold"),
    )
    return w.select(
        "document_id", F.lit("amount_zscore").alias("anomaly_type"), F.when(F.abs("z") >= limits.z_high, "HIGH").otherwise("MEDIUM").alias("severity"), F.round("z", 4).alias("score"), F.concat(F.lit("amount_zscore:"), F.col("vendor_key")).alias("fingerprint"),
        F.when(floored, steady).otherwise(spread).alias("reason"), F.to_json(evidence, _NULLS).alias("evidence"), "n",
    )


def term_drifts(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Payment terms other than those that a vendor's earlier invoices mostly had.

    Each row knows how often its vendor had had its own terms by then; the greatest such count among the earlier rows is that of their most common
    terms (of two as common neither reaches ``terms_share``).
    """
    return _term_drifts(prepared(invoices), limits)


def _term_drifts(prepared: DataFrame, limits: Limits) -> DataFrame:
    k = prepared.where("vendor_key <> '' and terms_key <> ''").select("document_id", "ingest_seq", "vendor_key", "terms_key", "vendor", "payment_terms", "crowded")

    def step(rows: DataFrame, before: Callable[..., DataFrame]) -> DataFrame:
        own = before(rows, ["vendor_key", "terms_key"], {"own_before": F.lit(1).cast("long")})
        return before(own, ["vendor_key"], {"n": F.lit(1).cast("long")}, {"top": F.struct((F.coalesce("own_before", F.lit(0)) + 1).alias("hits"), F.col("terms_key").alias("usual"))})

    return term_findings(_by_vendor(k, step).select("*", "top.hits", "top.usual"), limits)


def term_findings(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The same from invoices with what is known of their vendors' earlier terms: n, usual (the most common) and hits (how often)."""
    w = rows.where((F.col("n") >= limits.terms_history) & (F.col("hits") >= limits.terms_share * F.col("n")) & (F.col("usual") != F.col("terms_key")))
    share = F.round(F.try_divide("hits", "n"), 4)
    reason = _said("terms", F.col("vendor"), F.col("payment_terms"), F.col("hits"), F.col("n"), F.col("usual"))
    evidence = F.struct("vendor_key", F.col("payment_terms").alias("candidate_terms"), F.col("usual").alias("modal_terms"), F.col("hits").alias("modal_count"), F.col("n").alias("history_count"), share.alias("consistency"))
    return w.select(
        "document_id", F.lit("term_drift").alias("anomaly_type"), F.lit("MEDIUM").alias("severity"), share.alias("score"), F.concat(F.lit("term_drift:"), F.col("vendor_key")).alias("fingerprint"), reason.alias("reason"), F.to_json(evidence, _NULLS).alias("evidence"), "usual"
    )


def round_numbers(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Totals that are whole thousands, or else whole five hundreds."""
    whole = F.when(F.col("total") % 1000 == 0, 1000).when(F.col("total") % 500 == 0, 500)
    w = invoices.where(F.col("total") >= limits.round_least).withColumn("whole", whole).where("whole is not null")
    reason = _said("round", _amount("total"), F.coalesce("currency", F.lit("")), F.format_number("whole", 0))
    evidence = F.struct(F.col("total").cast("double").alias("total"), F.col("whole").alias("multiple_of"), "currency")
    return w.select(
        "document_id", F.lit("round_number").alias("anomaly_type"), F.when(F.col("whole") == 1000, "MEDIUM").otherwise("LOW").alias("severity"), F.col("whole").cast("double").alias("score"),
        F.concat(F.lit("round_number:"), F.col("whole").cast("string")).alias("fingerprint"), reason.alias("reason"), F.to_json(evidence, _NULLS).alias("evidence"),
    )


FINDING = ["document_id", "anomaly_type", "severity", "score", "fingerprint", "reason", "evidence"]


def screen(invoices: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """All findings of all detectors, each once for a document and fingerprint, with its rank and place among the document's: gravest first, then by type."""
    rows = prepared(invoices)
    return placed(_duplicates(rows, limits), _amount_zscores(rows, limits), _term_drifts(rows, limits), round_numbers(rows, limits))


def placed(*parts: DataFrame) -> DataFrame:
    """Findings of several detectors as ``screen`` gives them."""
    found = reduce(DataFrame.unionByName, (part.select(FINDING) for part in parts))
    place = Window.partitionBy("document_id").orderBy(F.desc("rank"), "anomaly_type", "fingerprint")
    return found.dropDuplicates(["document_id", "fingerprint"]).withColumn("rank", severity_rank(F.col("severity"))).withColumn("place", F.row_number().over(place))


def insert_new(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Findings not in the ledger yet: the first of a (document_id, fingerprint) stays."""
    return found.dropDuplicates(["document_id", "fingerprint"]).join(kept.select("document_id", "fingerprint"), ["document_id", "fingerprint"], "left_anti")
