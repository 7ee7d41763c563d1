"""Rules over one extracted record, as an array of checks; a rule whose inputs are missing gives no check."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import bound

LINE = "0.01"
TOTAL = "0.02"
VAT = "0.05"
VAT_SLACK = "0.0002"
FIRST_DAY = "1990-01-01"
SKEW_DAYS, LONGEST_DAYS = 1, 1095


# What is said of a rule that holds and of one that doesn't, as stored; %s stands for the values.
LABELS = {"vendor": "Vendor", "invoice_number": "Invoice number", "issue_date": "Issue date", "total": "Total", "currency": "Currency"}
SAID = {
    "present": ("%s was extracted.", "%s is missing, so the document cannot be auto-committed."),
    "total_positive": ("Total %s is a positive amount.", "Total %s is not a positive amount."),
    "line_item_math": ("All %s priced line item(s) multiply out correctly.", "%s line item(s) do not multiply out: %s%s"),
    "line_items_sum_to_subtotal": ("%s line item(s) sum to %s, matching the printed subtotal.", "%s line item(s) sum to %s but the subtotal reads %s — a difference of %s."),
    "subtotal_plus_tax_equals_total": ("Subtotal %s + tax %s equals the printed total %s.", "Subtotal %s + tax %s = %s, but the total reads %s — a difference of %s."),
    "uae_vat_rate": ("Tax of %s AED is the expected 5%% UAE VAT on a subtotal of %s.", "Tax of %s AED is %s%% of the %s subtotal, not the expected 5%% UAE VAT (%s)."),
    "date_sanity": ("Issue date %s is plausible.", "Issue date %s is outside the plausible range %s to %s."),
    "due_date_after_issue_date": ("Due date %s follows the issue date correctly.", "Due date %s precedes the issue date %s."),
    "due_too_late": "Due date %s is more than three years after the issue date %s.",
    "line": "line %s (%s): %s x %s = %s, but %s is printed",
    "unnamed": "unnamed",
    "more": " (+%s more)",
    "passed": "all checks passed",
    "unread": "Only %s of %s pages were read, so %s page(s) were never shown to the extractor.",
}
#: Lines that a message tells of.
TOLD = 3


def _money(text: str) -> Column:
    return F.lit(text).cast("decimal(8,4)")


def _is_priced(line: Column) -> Column:
    return line["qty"].isNotNull() & line["unit_price"].isNotNull() & line["amount"].isNotNull()


def bad_lines(described: str | None = "description") -> Column:
    """Lines whose amount isn't quantity times price: n (place among all lines), description, qty, unit_price, amount, and their product, half to even. Only these are made anew."""
    name = (lambda x: x[described].cast("string")) if described else (lambda x: F.lit(None).cast("string"))
    product = lambda x: F.bround(x["qty"] * x["unit_price"], 2)
    made = lambda x, i: F.struct((i + 1).alias("n"), name(x).alias("description"), x["qty"].alias("qty"), x["unit_price"].alias("unit_price"), x["amount"].alias("amount"), product(x).alias("product"))
    return F.filter(F.transform("line_items", lambda x, i: F.when(F.abs(x["amount"] - product(x)) > _money(LINE), made(x, i))), lambda x: x.isNotNull())


#: The twelve rules in order.
RULES = [*(f"{c}_present" for c in LABELS), "total_positive", "line_item_math", "line_items_sum_to_subtotal", "subtotal_plus_tax_equals_total", "uae_vat_rate", "date_sanity", "due_date_after_issue_date"]


def _asked(records: DataFrame, today: Column) -> DataFrame:
    """Records with ``_asked_`` and ``_passed_`` of each rule, and what both need of the lines: columns of their own, each worked out once by compiled code."""
    fields = records.schema["line_items"].dataType.elementType.names
    named = "description" if "description" in fields else None
    count = lambda kept: F.greatest(F.size(F.filter("line_items", kept)), F.lit(0))
    summed = F.aggregate("line_items", F.lit(0).cast("decimal(28,6)"), lambda s, x: (s + F.coalesce(x["amount"], F.lit(0).cast("decimal(18,6)"))).cast("decimal(28,6)"))
    of_lines = {"_bad": F.coalesce(bad_lines(named), F.array()), "_complete": count(_is_priced), "_amounts": count(lambda x: x["amount"].isNotNull()), "_sum": summed}
    sub, tax, total, issue, due = map(F.col, ("subtotal", "tax", "total", "issue_date", "due_date"))
    found = records.withColumns({**of_lines, "_vat": F.bround(sub * _money(VAT), 2), "_owed": sub + F.coalesce(tax, F.lit(0))})
    always = F.lit(True)
    rules = [
        *((always, F.coalesce(F.col(c).cast("string"), F.lit("")) != "") for c in LABELS),
        (total.isNotNull(), total > 0),
        (F.col("_complete") > 0, F.size("_bad") == 0),
        ((F.col("_amounts") > 0) & sub.isNotNull(), F.abs(F.col("_sum") - sub) <= _money(LINE) * F.col("_amounts")),
        (sub.isNotNull() & total.isNotNull(), F.abs(F.col("_owed") - total) <= _money(TOTAL)),
        (F.coalesce((F.col("currency") == "AED") & sub.isNotNull() & (tax != 0), F.lit(False)), F.abs(tax - F.col("_vat")) <= F.greatest(_money(TOTAL), F.abs(_money(VAT_SLACK) * sub))),
        (issue.isNotNull(), issue.between(F.lit(FIRST_DAY).cast("date"), F.date_add(today, SKEW_DAYS))),
        (issue.isNotNull() & due.isNotNull(), due.between(issue, F.date_add(issue, LONGEST_DAYS))),
    ]
    return found.withColumns({f"_{k}_{rule}": c for rule, pair in zip(RULES, rules, strict=True) for k, c in zip(("asked", "passed"), pair, strict=True)})


def outcomes(records: DataFrame, today: str | Column) -> DataFrame:
    """A row for each record and rule that can be asked of it: the record's columns, rule, passed. Nothing is said of them, so no message is made."""
    each = F.array(*(F.when(F.col(f"_asked_{r}"), F.struct(F.lit(r).alias("rule"), F.col(f"_passed_{r}").alias("passed"))) for r in RULES))
    return _asked(records, _day(today)).select(*records.columns, F.explode(each).alias("_check")).where("_check is not null").select(*records.columns, "_check.rule", "_check.passed")


def _day(today: str | Column) -> Column:
    return F.lit(today).cast("date") if isinstance(today, str) else today


def _fill(sentence: str, *values: Column) -> Column:
    """A sentence with its values in the places of %s."""
    parts = sentence.replace("%%", "%").split("%s")
    return F.concat(F.lit(parts[0]), *(x for value, part in zip(values, parts[1:], strict=True) for x in (F.coalesce(value.cast("string"), F.lit("null")), F.lit(part))))


def _told(asked: DataFrame, today: Column) -> DataFrame:
    """``_asked`` with ``_message_``, ``_expected_`` and ``_observed_`` of each rule; what messages show is rounded in one place."""
    sub, tax, total, bad = F.col("subtotal"), F.col("tax"), F.col("total"), F.col("_bad")
    shown = {
        "sub": sub, "tax": F.coalesce(tax, F.lit(0)), "total": total, "owed": F.col("_owed"), "vat": F.col("_vat"), "summed": F.col("_sum"), "sum_gap": F.abs(F.col("_sum") - sub), "owed_gap": F.abs(F.col("_owed") - total),
        "rate": F.when(sub != 0, 100 * tax / sub).otherwise(F.lit(0)),
    }
    flat = F.flatten(F.transform(F.slice(bad, 1, TOLD), lambda x: F.array(*(x[c].cast("decimal(38,6)") for c in ("qty", "unit_price", "product", "amount")))))
    values = F.concat(F.array(*(c.cast("decimal(38,6)") for c in shown.values())), flat)
    found = asked.withColumn("_texts", F.transform(values, lambda x: F.coalesce(F.bround(x, 2).cast("decimal(38,2)").cast("string"), F.lit("null"))))
    t = {n: F.get("_texts", F.lit(i)) for i, n in enumerate(shown)}
    of_line = lambda i, k: F.get("_texts", F.lit(len(shown) + k) + 4 * i)
    issue, due = F.col("issue_date"), F.col("due_date")
    day, due_day, first, last = issue.cast("string"), due.cast("string"), F.lit(FIRST_DAY), F.date_add(today, SKEW_DAYS).cast("string")
    wrong = F.transform(F.slice(bad, 1, TOLD), lambda x, i: _fill(SAID["line"], x["n"], F.coalesce(F.nullif(x["description"], F.lit("")), F.lit(SAID["unnamed"])), *(of_line(i, k) for k in range(4))))
    more = F.when(F.size(bad) > TOLD, _fill(SAID["more"], F.size(bad) - TOLD)).otherwise("")
    late = _fill(SAID["due_too_late"], due_day, day)

    def said(rule: str, good: list, wrong: list) -> tuple[Column, Column]:
        return tuple(_fill(x, *values) for x, values in zip(SAID[rule], (good, wrong), strict=True))

    due_good, due_bad = said("due_date_after_issue_date", [due_day], [due_day, day])
    says = {
        **{f"{c}_present": (*(F.lit(x % label) for x in SAID["present"]), F.lit("a non-null value"), F.when(F.col(f"_passed_{c}_present"), "present").otherwise("null")) for c, label in LABELS.items()},
        "total_positive": (*said("total_positive", [t["total"]], [t["total"]]), F.lit("> 0.00"), t["total"]),
        "line_item_math": (*said("line_item_math", [F.col("_complete")], [F.size(bad), F.array_join(wrong, "; "), more]), F.when(F.size(bad) > 0, "qty x unit_price == amount"), F.when(F.size(bad) > 0, _fill("%s of %s lines mismatched", F.size(bad), F.col("_complete")))),
        "line_items_sum_to_subtotal": (*said("line_items_sum_to_subtotal", [F.col("_amounts"), t["summed"]], [F.col("_amounts"), t["summed"], t["sub"], t["sum_gap"]]), t["sub"], t["summed"]),
        "subtotal_plus_tax_equals_total": (*said("subtotal_plus_tax_equals_total", [t["sub"], t["tax"], t["total"]], [t["sub"], t["tax"], t["owed"], t["total"], t["owed_gap"]]), t["owed"], t["total"]),
        "uae_vat_rate": (*said("uae_vat_rate", [t["tax"], t["sub"]], [t["tax"], t["rate"], t["sub"], t["vat"]]), t["vat"], t["tax"]),
        "date_sanity": (*said("date_sanity", [day], [day, first, last]), F.concat(first, F.lit(".."), last), day),
        "due_date_after_issue_date": (due_good, F.when(due < issue, due_bad).otherwise(late), F.concat(F.lit(">= "), day), due_day),
    }
    told = {}
    for rule, (good, wrong_one, expected, observed) in says.items():
        told |= {f"_message_{rule}": F.when(F.col(f"_asked_{rule}"), F.when(F.col(f"_passed_{rule}"), good).otherwise(wrong_one)), f"_expected_{rule}": expected, f"_observed_{rule}": observed}
    return found.withColumns(told)


def validate(records: DataFrame, today: str | Column) -> DataFrame:
    """Records with checks (rule, passed, message, expected, observed; without those that can't be asked), passed, failed_rules, and summary ("rule: message; ..." of the failures)."""
    found = _told(_asked(records, _day(today)), _day(today))
    of = lambda k, r: F.col(f"_{k}_{r}")
    fails = {r: F.coalesce(of("asked", r) & ~of("passed", r), F.lit(False)) for r in RULES}
    failed = reduce(or_, fails.values())
    some = lambda when, x: F.when(when, F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    each = F.flatten(F.array(*(some(of("asked", r), F.struct(F.lit(r).alias("rule"), *(of(k, r).alias(k) for k in ("passed", "message", "expected", "observed")))) for r in RULES)))
    summary = F.concat_ws("; ", *(F.when(fails[r], F.concat(F.lit(f"{r}: "), of("message", r))) for r in RULES))
    return found.select(*records.columns, each.alias("checks"), (~failed).alias("passed"), F.flatten(F.array(*(some(fails[r], F.lit(r)) for r in RULES))).alias("failed_rules"), F.when(~failed, SAID["passed"]).otherwise(summary).alias("summary"))


def card(validated: DataFrame, most: int = 6) -> DataFrame:
    """What a result's card shows: the checks that failed, the first lines, and how many more there are."""
    return validated.select("document_id", F.filter("checks", lambda c: ~c["passed"]).alias("failing"), F.slice("line_items", 1, most).alias("lines"), F.greatest(F.lit(0), F.size("line_items") - most).alias("more"))


def commit_gate(valid: Column, summary: Column, gravest: Column, reason: Column, read: Column, pages: Column, note: Column | None = None) -> Column:
    """DONE or NEEDS_REVIEW with its first reason: pages that weren't read (and what failed besides), what failed (``note``, if there is one, or the summary), the reason of the gravest finding if that is HIGH."""
    unread = unread_pages(read, pages)
    high = F.coalesce(gravest, F.lit("")).isin("HIGH", "CRITICAL")
    told = F.concat(F.format_string(SAID["unread"], read, pages, unread), F.when(~valid, F.concat(F.lit(" "), summary)).otherwise(""))
    failed = summary if note is None else F.coalesce(F.nullif(note, F.lit("")), summary)
    return F.struct(
        F.when((unread > 0) | ~valid | high, "NEEDS_REVIEW").otherwise("DONE").alias("status"),
        F.when(unread > 0, told).when(~valid, failed).when(high, reason).alias("reason"),
    )


def unread_pages(read: Column, total: Column) -> Column:
    return F.greatest(F.lit(0), F.coalesce(total - read, F.lit(0)))
