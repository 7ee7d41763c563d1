"""Text of documents to records, and back for round trips; word boxes to lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import CURRENCY_CODES, bound, date, money

# Words that hint at a kind of document, in the order in which ties fall.
KIND_HINTS = {
    "contract": ["agreement", "this contract", "statement of work", "terms and conditions", "hereinafter", "party of the"],
    "receipt": ["receipt", "paid in full", "payment received", "change due", "cash tendered", "thank you for your payment"],
    "invoice": ["invoice", "amount due", "bill to", "payment terms", "total due", "vat", "purchase order"],
}
# How labelled fields, amounts, tables, numbers, currency signs and lines that are no vendor look.
DAY = r"([0-9]{1,4}[-/. ][A-Za-z0-9]{1,9}[-/. ][0-9]{2,4}|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})"
LABEL = {
    "invoice_number": r"(?i)(?:invoice|inv|bill|document|reference|ref)[ \t]*(?:no\.?|number|num|#|id)?[ \t]*[:#][ \t]*(?=[A-Z0-9\-/_]*\d)([A-Z0-9][A-Z0-9\-/_]{2,30})",
    "issue_date": r"(?im)(?:invoice\s*date|issue\s*date|issued(?:\s*on)?|date\s*of\s*issue|^\s*date)\s*[:#]?\s*" + DAY,
    "due_date": r"(?i)(?:due\s*date|payment\s*due|due\s*by|pay\s*by)\s*[:#]?\s*" + DAY,
    "payment_terms": r"(?i)(?:payment\s*terms|terms\s*of\s*payment|terms)\s*[:#]?\s*([^\n]{2,60})",
}
AMOUNT_TAIL = r"\s*[:#]?\s*[^\d\-(]{0,12}(\(?-?[\d,.\x20]+\)?)"
AMOUNT = {
    "subtotal": r"(?i)(?:sub[\s-]*total|net\s*amount|amount\s*before\s*(?:tax|vat))" + AMOUNT_TAIL,
    "tax": r"(?i)(?:vat|tax|gst)(?:\s*@?\s*\d{1,2}(?:\.\d+)?\s*%)?" + AMOUNT_TAIL,
    "total": r"(?i)(?:grand\s*total|total\s*due|amount\s*due|balance\s*due|total\s*payable|total)" + AMOUNT_TAIL,
}
NO_REFERENCE = [r"^\d{4}$", r"^[\d/.\-]{8,}$"]
TABLE_HEAD = r"(?i)(?=[dip])(description|item|particulars).*(qty|quantity).*(price|rate|amount)"
TABLE_END = r"(?i)^\s*(sub[\s-]*total|total|vat|tax|grand\s*total|amount\s*due|balance|payment\s*terms|bank|iban|swift|notes?|thank)"
NUMBER_AHEAD = r"(?=[(\d-])"  # how a number can begin, which most letters tell at once
NUMBER = r"\(?-?(?:\d{1,3}+(?:[,\x20\xA0]\d{3})+(?:\.\d{1,4})?|\d+(?:\.\d{1,4})?)\)?"
SYMBOLS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "د.إ": "AED"}
NO_VENDOR = [r"(?i)^\s*(tax\s+invoice|invoice|receipt|credit\s*note|proforma|statement|bill)\s*$", r"(?i)\b(?:trn|tax\s*reg|vat\s*reg|gstin)\b", r"^[\d\W_]+$", r"(?i)\b(invoice|date|page)\s*(no(?:tes?)?(?![a-z])|#|:)"]  # whole words: "Gpagenoc" is a name


#: Lines of one record.
MOST_LINES = 200


def kind(text: Column) -> Column:
    """The kind with most hints in the text (as substrings); ties fall to contract, receipt, invoice; none: unknown."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    score = {k: sum((F.when(lower.contains(h), 1).otherwise(0) for h in hints), F.lit(0)) for k, hints in KIND_HINTS.items()}
    best = F.greatest(*score.values())
    out = F.lit("invoice")
    for k in ("receipt", "contract"):
        out = F.when(score[k] == best, k).otherwise(out)
    return F.when(best == 0, "unknown").otherwise(out)


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _last(text: Column, pattern: str) -> Column:
    """The last match that is an amount."""
    return F.try_element_at(F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), money), lambda v: v.isNotNull()), F.lit(-1))


def _lines(text: Column) -> Column:
    return F.split(text, r"\R")


def _value(number: Column) -> Column:
    """``money`` of what ``NUMBER`` matches: its commas or spaces can only part thousands, so no pattern is needed unless it has both."""
    bare = reduce(lambda text, sign: F.replace(text, F.lit(sign), F.lit("")), "(), \u00a0", number)
    value = bare.try_cast("decimal(18,6)")
    mixed = number.contains(",") & (number.contains(" ") | number.contains("\u00a0"))
    return F.when(mixed, money(number)).when(number.startswith("(") & number.endswith(")"), -F.abs(value)).otherwise(value).cast("decimal(18,6)")


def _table(text: Column) -> Column:
    """Lines between the first header and the next stop word.

    Every line is looked at once to tell what it is; the table is a slice between two places.
    """

    def rows(lines: Column) -> Column:
        kinds = F.transform(lines, lambda x: F.when(x.rlike(TABLE_HEAD), "head").when(x.rlike(TABLE_END), "end").otherwise("row"))

        def between(k: Column) -> Column:
            head = F.array_position(k, "head").cast("int")

            def kept(behind: Column) -> Column:
                end = F.array_position(behind, "end").cast("int")
                return F.filter(F.slice(lines, head + 1, F.when(end > 0, end - 1).otherwise(F.size(behind))), lambda x, i: F.get(behind, i) == "row")

            return F.when(head > 0, bound(F.slice(k, head + 1, F.size(k)), kept)).otherwise(F.slice(lines, 1, 0))

        return bound(kinds, between)

    return bound(_lines(text), rows)


def _pieces(line: Column) -> Column:
    """A line cut where its numbers begin; each piece but the first is a number, a mark and what stands behind it."""
    return F.split(F.regexp_replace(line, "(" + NUMBER_AHEAD + NUMBER + ")", "\u0001$1\u0002"), "\u0001")


def _cells(pieces: Column) -> dict[str, Column]:
    """What stands before the last three numbers, squeezed, and those numbers, as texts; null if there are fewer."""
    n = F.size(pieces)
    before = F.replace(F.array_join(F.slice(pieces, F.lit(1), F.greatest(n - 3, F.lit(0))), ""), F.lit("\u0002"), F.lit(""))
    cells = {"description": F.trim(F.regexp_replace(before, r"\s+", " ")), **{c: F.substring_index(F.get(pieces, n - k), "\u0002", 1) for k, c in ((3, "qty"), (2, "unit_price"), (1, "amount"))}}
    return {c: F.when(n > 3, x) for c, x in cells.items()}


def _item(cells: dict[str, Column]) -> Column:
    described = cells["description"]
    return F.struct(F.when(described != "", F.substring(described, 1, 512)).alias("description"), *(_value(cells[c]).alias(c) for c in ("qty", "unit_price", "amount")))


def _read(line: Column) -> Column:
    """A line's item, within an array."""
    cells = bound(_pieces(line), lambda p: F.struct(*(x.alias(c) for c, x in _cells(p).items())))
    return bound(cells, lambda c: _item({k: c[k] for k in ("description", "qty", "unit_price", "amount")}))


def _is_whole(item: Column) -> Column:
    return item["qty"].isNotNull() & item["unit_price"].isNotNull() & item["amount"].isNotNull()


def table_lines(text: Column) -> Column:
    """Rows of the item table: lines between the first header and the next stop word whose last three numbers are quantity, price and amount."""
    return F.slice(F.filter(F.transform(_table(text), _read), _is_whole), 1, MOST_LINES)


def _within_a_page() -> tuple[str, str]:
    r"""Patterns for whole pages: the first header with what follows its line as last group, and the break before a stop line with all behind it. \v is what \R takes for an end of a line."""
    head = TABLE_HEAD.removeprefix("(?i)").replace(".*", r"\V*")
    end = TABLE_END.removeprefix(r"(?i)^").replace(r"[\s-]", r"[ \t-]").replace(r"\s", r"[ \t]")
    return rf"(?is){head}\V*(.*)", rf"(?is)\v(?={end})(?!\V*{head}).*"


def table_rows(pages: DataFrame, text: str = "text") -> DataFrame:
    """A row for each of a page's ``table_lines``: the page's other columns, description, qty, unit_price, amount.

    The table is cut out of the whole page and its lines become rows, so that compiled code reads them. Tables of more than ``MOST_LINES`` lines or with repeated headers are cut to their first items before that.
    """
    kept = [c for c in pages.columns if c != text]
    head, end = _within_a_page()
    found = pages.select(*kept, F.regexp_replace(F.regexp_extract(text, head, 4), end, "").alias("_table"))
    lines = found.select(*kept, "_table", _lines(F.col("_table")).alias("_lines"))
    first = F.slice(F.filter("_lines", lambda x: ~x.rlike(TABLE_HEAD) & _is_whole(_read(x))), 1, MOST_LINES)
    each = lines.select(*kept, F.explode(F.when((F.size("_lines") <= MOST_LINES) & ~F.col("_table").rlike(TABLE_HEAD), F.col("_lines")).otherwise(first)).alias("_line"))
    cut = each.select(*kept, _pieces(F.col("_line")).alias("_pieces"))
    cells = cut.select(*kept, *(x.alias(f"_{c}") for c, x in _cells(F.col("_pieces")).items()))
    described, numbers = F.col("_description"), ("qty", "unit_price", "amount")
    items = cells.select(*kept, F.when(described != "", F.substring(described, 1, 512)).alias("description"), *(_value(F.col(f"_{c}")).alias(f"_{c}") for c in numbers))
    item = F.struct(*(F.col(f"_{c}").alias(c) for c in numbers))
    return items.select(*kept, "description", F.inline(F.when(_is_whole(item), F.array(item))))  # a filter would be moved below and read each line again


def vendor(text: Column) -> Column:
    """The first of eight lines whose cell before a gap of two spaces can be a name."""
    cells = F.transform(F.slice(_lines(text), 1, 8), lambda x: F.trim(F.element_at(F.split(F.trim(x), r"\s{2,}"), 1)))
    good = F.filter(cells, lambda c: (F.length(c) >= 3) & ~reduce(lambda a, b: a | b, (c.rlike(p) for p in NO_VENDOR)))
    return F.substring(F.try_element_at(good, F.lit(1)), 1, 256)


def _reference(text: Column) -> Column:
    """The first labelled reference, unless it looks like a date or a year."""
    return bound(_first(text, LABEL["invoice_number"]), lambda c: F.when(~(c.rlike(NO_REFERENCE[0]) | c.rlike(NO_REFERENCE[1])), c))


def parse(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages with the columns of a record: numbers, dates and terms by their first labels, amounts by their last.

    Amounts are a stage of their own, so that what needs several of them doesn't read them again.
    """
    t = F.col(text)
    signs = reduce(lambda found, s: found.when(t.contains(s[0]), s[1]), list(SYMBOLS.items())[1:], F.when(t.contains("$"), "USD"))
    amounts = bound(F.struct(*(_last(t, pattern).alias(k) for k, pattern in AMOUNT.items())), lambda a: a)
    terms = bound(_first(t, LABEL["payment_terms"]), lambda x: F.btrim(F.element_at(F.split(F.trim(x), r"\s{2,}"), 1), F.lit(" .;")))
    read = pages.select(
        *(c for c in pages.columns if c != text), vendor(t).alias("vendor"), _reference(t).alias("invoice_number"), date(_first(t, LABEL["issue_date"])).alias("issue_date"), date(_first(t, LABEL["due_date"])).alias("due_date"),
        F.coalesce(_first(t, r"\b(" + "|".join(CURRENCY_CODES) + r")\b"), signs).alias("currency"), terms.alias("payment_terms"), table_lines(t).alias("line_items"), amounts.alias("amounts"),
    )
    a = {k: F.col(f"amounts.{k}") for k in AMOUNT}
    total = F.when((a["total"] == a["subtotal"]) & (a["tax"] != 0), a["subtotal"] + a["tax"]).otherwise(a["total"])  # "total" was met within "subtotal"
    return read.withColumns({"subtotal": a["subtotal"], "tax": a["tax"], "total": total.cast("decimal(18,6)")}).drop("amounts")


# Labels and forms of the printed pages, by layout: number, issue date, due date, table head, subtotal, tax, total, terms.
LAYOUTS = [
    ("Invoice No: ", "Invoice Date: ", "dd MMM yyyy", "Description   Qty   Unit Price   Amount", "Subtotal: ", "VAT: ", "Grand Total: ", "Payment Terms: "),
    ("Reference: ", "Date of issue: ", "MMMM d, yyyy", "Item  Quantity  Rate  Amount", "Sub Total ", "GST ", "Balance due: ", "Terms of payment: "),
    ("Document # ", "Issued on ", "yyyy-MM-dd", "Particulars | Qty | Price", "Net amount: ", "Tax: ", "Total payable: ", "Terms: "),
]


def render(records: DataFrame, layout: Column | None = None) -> DataFrame:
    """document_id, text: a printed page for each record, in one of ``LAYOUTS`` (the first by default).

    Other layouts also print currencies behind lines, a bank line, thousands parted by spaces, and a last total that is no amount.
    """
    which = F.lit(0) if layout is None else layout
    of = lambda k: F.get(F.array(*(F.lit(x[k]) for x in LAYOUTS)), which)
    shown = lambda c: F.when(which == 2, F.replace(F.format_number(c, 2), F.lit(","), F.lit(" "))).otherwise(F.format_number(c, 2))
    two = lambda c: F.coalesce(shown(F.bround(c, 2)), F.lit(""))
    day = lambda c: F.when(which == 0, F.date_format(c, LAYOUTS[0][2])).when(which == 1, F.date_format(c, LAYOUTS[1][2])).otherwise(F.date_format(c, LAYOUTS[2][2]))
    line = lambda x: F.concat(F.lit("Part "), x["part"].cast("string"), F.lit(" x   "), F.format_number(x["qty"], 2), F.lit("   "), F.format_number(x["unit_price"], 4), F.lit("   "), F.format_number(x["amount"], 2), F.when(which == 1, " AED").otherwise(""))
    text = F.concat_ws(
        "\n", F.concat(F.coalesce("vendor", F.lit("")), F.lit("      TAX INVOICE")), F.concat(of(0), F.col("invoice_number")), F.concat(of(1), day("issue_date")), F.concat(F.lit("Due Date: "), F.date_format("due_date", "dd/MM/yyyy")),
        F.concat(F.lit("Currency: "), F.col("currency")), of(3), F.nullif(F.array_join(F.transform("line_items", line), "\n"), F.lit("")), F.when(which == 1, "IBAN AE07 0331 2345 6789"), F.concat(of(4), two(F.col("subtotal"))), F.when(F.col("tax").isNotNull(), F.concat(of(5), two(F.col("tax")))),
        F.concat(of(6), two(F.col("total"))), F.when(which == 1, "Total: n/a"), F.concat(of(7), F.col("payment_terms")),
    )
    return records.select("document_id", text.alias("text"))


def layout(words: DataFrame, drift: float = 3.2, advance: float = 4.0, most_gap: int = 12) -> DataFrame:
    """Lines of a page from word boxes (page_id, x0, y0, x1, word).

    A row of words takes those within ``drift`` of its first word's top. A fold over a page's distinct tops in order keeps the first one of each row, so what it holds grows with rows, not with words; a word's row is the last that
    begins at or above it. Then words are set apart by as many spaces as their gap holds. A page's words are one group, as a page is bounded.
    """
    boxes = words.groupBy("page_id").agg(F.collect_list(F.struct("y0", "x0", "x1", "word")).alias("w"))
    new = lambda tops, y: F.coalesce(y - F.try_element_at(tops, F.lit(-1)) > drift, F.lit(True))
    tops = F.aggregate(F.array_sort(F.array_distinct(F.transform("w", lambda w: w["y0"]))), F.array().cast("array<double>"), lambda tops, y: F.when(new(tops, y), F.concat(tops, F.array(y))).otherwise(tops))
    flat = boxes.withColumn("tops", tops).select("page_id", "tops", F.explode("w").alias("w")).select("page_id", (F.size(F.filter("tops", lambda t: t <= F.col("w.y0"))) - 1).alias("row"), "w.x0", "w.x1", "w.word")
    order = Window.partitionBy("page_id", "row").orderBy("x0", "x1", "word")
    gap = F.col("x0") - F.lag("x1").over(order)
    spaced = flat.withColumn("piece", F.concat(F.when(gap.isNull(), "").otherwise(F.repeat(F.lit(" "), F.greatest(F.lit(1), F.least(F.lit(most_gap), F.floor(gap / advance).cast("int"))))), F.col("word"))).withColumn("k", F.row_number().over(order))
    lines = spaced.groupBy("page_id", "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "piece"))), lambda p: p["piece"]), "").alias("line"))
    return lines.select("page_id", "row", "line")
