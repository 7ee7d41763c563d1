"""Captions, previews and other small functions over the ledger's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def due_date(issue: Column, terms: Column) -> Column:
    """Net 15, 30 or 45 days after the issue, else the same day."""
    return F.date_add(issue, F.when(terms == "net 15", 15).when(terms == "net 30", 30).when(terms == "net 45", 45).otherwise(0))


def page_zoom(width: Column, height: Column, long_edge: float = 1500.0, most: float = 4.0, most_pixels: float = 40e6) -> Column:
    """The scale that brings a page's long edge to ``long_edge``, ``most`` at most, and its area under ``most_pixels``."""
    zoom = F.least(long_edge / F.greatest(width, height), F.lit(most))
    pixels = width * height * zoom * zoom
    return F.when(pixels > most_pixels, zoom * F.sqrt(most_pixels / pixels)).otherwise(zoom)


def fenced(text: Column, opens: str, closes: str) -> Column:
    """The text between two delimiters; '' if they are missing or in the wrong order."""
    start, stop = F.instr(text, opens), F.instr(text, closes)
    return F.when((start > 0) & (stop >= start + len(opens)), F.substring(text, start + len(opens), stop - start - len(opens))).otherwise("")


def lane(media_type: Column, chars: Column, pages: Column, least: int = 60) -> Column:
    """text for PDFs with enough characters a page, else vision."""
    return F.when((media_type == "application/pdf") & (chars / F.greatest(pages, F.lit(1)) >= least), "text").otherwise("vision")


def coerced_lane(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin("text", "digital", "digital_text", "native"), "text").otherwise("vision")


def coerced_kind(raw: Column) -> Column:
    word = F.lower(F.trim(raw))
    return F.when(word.isin("invoice", "receipt", "contract"), word).otherwise("unknown")


def confidence(raw: Column) -> Column:
    """0 to 1; what can't be read is 0."""
    value = raw.try_cast("double")
    return F.when(value.isNull() | F.isnan(value), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def client(forwarded: Column, peer: Column, hops: int = 1) -> Column:
    """The address ``hops`` from the end of a chain of proxies, else the peer's."""
    chain = F.filter(F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(chain) >= hops, F.try_element_at(chain, F.lit(-hops))).otherwise(peer)


def backoff_ceiling(attempt: Column, base: float = 0.5, most: float = 8.0) -> Column:
    return F.least(base * F.pow(F.lit(2.0), attempt), F.lit(most))


def compact_money(value: Column) -> Column:
    """1.2M, 3.4K or two decimals."""
    return F.when(F.abs(value) >= 1e6, F.concat(F.format_number(value / 1e6, 1), F.lit("M"))).when(F.abs(value) >= 1e3, F.concat(F.format_number(value / 1e3, 1), F.lit("K"))).otherwise(F.format_number(value, 2))


def _fixed(value: Column, digits: int) -> Column:
    return F.round(value.cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})").cast("string")


def size_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(_fixed(n / 1024, 1), F.lit(" KB"))).otherwise(F.concat(_fixed(n / 1048576, 1), F.lit(" MB")))


def cost_text(usd: Column) -> Column:
    """Dollars with two decimals, four below a cent."""
    return F.when(usd == 0, "$0.00").otherwise(F.concat(F.lit("$"), F.when(usd < 0.01, _fixed(usd, 4)).otherwise(_fixed(usd, 2))))


def latency_text(ms: Column) -> Column:
    """Whole milliseconds below a second, else seconds: two decimals below ten, one beyond; null is a dash."""
    seconds = ms.cast("decimal(18,3)") * F.lit("0.001").cast("decimal(4,3)")
    text = F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).otherwise(F.concat(F.when(ms < 10_000, _fixed(seconds, 2)).otherwise(_fixed(seconds, 1)), F.lit(" s")))
    return F.when(ms.isNull(), "—").otherwise(text)


def age_text(then: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now) - F.unix_timestamp(then)
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))


def humanised(event: Column) -> Column:
    """What follows the first dot, as words, the first letter in upper case."""
    words = F.translate(F.substring(event, F.instr(event, ".") + 1, F.length(event)), "_", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def caption(event: Column, payload: Column) -> Column:
    """What an event of the log says of its stage, from its JSON."""
    get = lambda k: F.get_json_object(payload, f"$.{k}")
    repairs = F.coalesce(get("repair_attempts").try_cast("int"), F.lit(0))
    items = F.when(get("line_items").rlike(r"^\d+$"), F.concat(get("line_items"), F.lit(" line item(s)"))).otherwise("fields extracted")
    failures = F.coalesce(F.size(F.from_json(get("failures"), "array<string>")), F.lit(0))
    findings, history = get("findings").try_cast("int"), get("history_size").try_cast("int")
    return (
        F.when(event == "document.received", F.concat(F.format_number(get("size_bytes").try_cast("long"), 0), F.lit(" bytes hashed")))
        .when(event == "pipeline.routed", F.concat(F.coalesce(get("doc_kind"), F.lit("document")), F.lit(" · "), F.coalesce(get("lane"), F.lit("")), F.lit(" lane")))
        .when(event == "pipeline.extraction_succeeded", F.when(repairs > 0, F.concat(items, F.lit(" · "), repairs.cast("string"), F.lit(" repair(s)"))).otherwise(items))
        .when(event == "pipeline.validation_passed", F.when(get("checks").rlike(r"^\d+$"), F.concat(get("checks"), F.lit(" checks passed"))).otherwise("all checks passed"))
        .when(event == "pipeline.validation_failed", F.when(failures > 0, F.concat(failures.cast("string"), F.lit(" rule(s) failed"))).otherwise("validation failed"))
        .when(event == "pipeline.screening_completed", F.when(findings > 0, F.concat(findings.cast("string"), F.lit(" anomaly flag(s)"))).when(history.isNotNull(), F.concat(F.lit("clean against "), history.cast("string"), F.lit(" prior invoice(s)"))).otherwise("screened"))
        .when(event == "ledger.committed", F.coalesce(get("status"), F.lit("committed")))
    )
