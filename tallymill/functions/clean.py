"""Cleaning of messy text into typed values, as column expressions that stay in code generation.

All take and give Columns; null stays null unless said otherwise. Casts are try_casts, so bad text gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms that a vendor's key leaves out, as patterns over lower-case text.
LEGAL_FORMS = [r"l\.?l\.?c", "ltd", "limited", "inc", "incorporated", "co", "company", "corp", "corporation", "fz[- ]?llc", "fzco", "fze", "dmcc", "plc", "gmbh", "sarl", "pvt", "private"]

# Currency signs and spellings, and their codes.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "AED": "AED", "DHS": "AED"}
CURRENCY_CODES = ["AED", "USD", "EUR", "GBP", "INR", "SAR", "QAR", "KWD", "OMR", "BHD"]

# Date layouts, in the order in which they are tried.
DATE_LAYOUTS = ["yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyy/M/d", "d.M.yyyy"]

# Leading bytes of the accepted file kinds, and the declared types each may come under.
MAGIC = [("255044462D", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg")]
DECLARED = {"application/pdf": ["application/pdf", "application/x-pdf", "application/octet-stream"], "image/png": ["image/png", "application/octet-stream"], "image/jpeg": ["image/jpeg", "image/jpg", "application/octet-stream"]}

# Labels whose values are secret, and how secrets look that have no label.
SECRET_LABELS = ["authorization", "proxy-authorization", "x-api-key", "api[-_]?key", "access[-_]?token", "refresh[-_]?token", "secret[-_]?key", "client[-_]?secret", "password", "passwd", "secret", "token"]
SECRET_FORMS = [r"sk-ant-[A-Za-z0-9_\-]{8,}", r"(?:sk|pk)-lf-[A-Za-z0-9_\-]{8,}", r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{20,}", r"postgres(?:ql)?(?:\+\w+)?://[^:\s]+:[^@\s]+@"]
REDACTED = "[REDACTED]"


def squeeze(text: Column) -> Column:
    """White space collapsed and trimmed; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def money(raw: Column) -> Column:
    """decimal(18,6) of an amount as people write it.

    Brackets negate. If comma and dot both occur the later one is the decimal sign. Commas alone part
    thousands if exactly three digits follow the last one, else they are decimal signs; a dot alone is one.
    """

    def read(text: Column) -> Column:
        def digits(kept: Column) -> Column:
            comma, dot = F.instr(kept, ","), F.instr(kept, ".")
            later_comma = F.instr(F.reverse(kept), ",") < F.instr(F.reverse(kept), ".")
            bare, dotted = F.replace(kept, F.lit(","), F.lit("")), F.replace(kept, F.lit(","), F.lit("."))
            thousands = kept.rlike(r",\d{3}$")
            return F.when(comma == 0, kept).when(dot > 0, F.when(later_comma, F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(bare)).when(thousands, bare).otherwise(dotted)

        value = bound(F.regexp_replace(text, r"[^\d.,-]", ""), digits).try_cast("decimal(18,6)")
        negative = text.startswith("(") & text.endswith(")")
        return F.when(negative, bound(value, lambda v: F.when(v > 0, -v).otherwise(v))).otherwise(value)

    return bound(F.trim(raw), read).cast("decimal(18,6)")


def date(raw: Column) -> Column:
    """A date in any of ``DATE_LAYOUTS``, day before month where both fit. A text's shape tells which layouts are tried."""

    def read(text: Column) -> Column:
        out, named = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")), r"[^\W\d_]"
        shapes = [
            (r"^\d{1,2}/\d{1,2}/\d{4}$", ["d/M/yyyy", "M/d/yyyy"]),
            (r"^\d{1,2}-\d{1,2}-\d{4}$", ["d-M-yyyy"]),
            (rf"^\d{{1,2}} {named}{{3}} \d{{4}}$", ["d MMM yyyy"]),
            (rf"^\d{{1,2}} {named}+ \d{{4}}$", ["d MMMM yyyy"]),
            (rf"^{named}{{3}} \d{{1,2}}, \d{{4}}$", ["MMM d, yyyy"]),
            (rf"^{named}+ \d{{1,2}}, \d{{4}}$", ["MMMM d, yyyy"]),
            (r"^\d{4}/\d{1,2}/\d{1,2}$", ["yyyy/M/d"]),
            (r"^\d{1,2}\.\d{1,2}\.\d{4}$", ["d.M.yyyy"]),
        ]
        for shape, layouts in shapes:
            out = out.when(text.rlike(shape), F.coalesce(*(F.try_to_date(text, layout) for layout in layouts)))
        return out

    return bound(F.trim(F.regexp_replace(raw, r"\s+", " ")), read)


def currency(raw: Column) -> Column:
    """A code: signs and spellings are mapped, anything else is cut to 8 characters."""
    text = F.upper(F.trim(raw))
    mapped = reduce(lambda found, pair: found.when(text == pair[0], pair[1]), list(CURRENCY_SIGNS.items())[1:], F.when(text == "$", "USD"))
    return F.nullif(mapped.otherwise(F.substring(text, 1, 8)), F.lit(""))


def vendor_key(name: Column) -> Column:
    """Lower case, without legal forms, punctuation and spare space; null and names of nothing else give ''."""
    lower = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    bare = F.regexp_replace(lower, r"\b(" + "|".join(LEGAL_FORMS) + r")\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9 ]+", " "), r"\s+", " "))


def terms_key(terms: Column) -> Column:
    """"NET30", "Net 30" and "net-30" alike give "net 30"; null gives ''."""
    plain = F.regexp_replace(F.lower(F.trim(F.coalesce(terms, F.lit("")))), r"[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\bnet\s*(\d+)\b", "net $1"), r"\s+", " "))


def media_type(content: Column) -> Column:
    """The kind of file that leading bytes tell; null for others and for fewer than 8 bytes."""
    start = F.hex(F.substring(content, 1, 8))
    found = reduce(lambda w, m: w.when(start.startswith(m[0]), m[1]), MAGIC[1:], F.when(start.startswith(MAGIC[0][0]), MAGIC[0][1]))
    return F.when(F.octet_length(content) >= 8, found)


def upload_verdict(content: Column, declared: Column, most_bytes: int = 10 * 1024 * 1024) -> Column:
    """The first reason against an upload, in the order empty, too_large, unsupported, mismatch; else null."""
    kind = media_type(content)
    said = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    agrees = reduce(lambda w, m: w.when(kind == m[0], said.isin(m[1])), list(DECLARED.items())[1:], F.when(kind == "application/pdf", said.isin(DECLARED["application/pdf"]))).otherwise(False)
    size = F.coalesce(F.octet_length(content), F.lit(0))
    return F.when(size == 0, "empty").when(size > most_bytes, "too_large").when(kind.isNull(), "unsupported").when(declared.isNotNull() & (said != "") & ~agrees, "mismatch")


def filename(raw: Column) -> Column:
    """The last path component without control and direction characters, stripped of spaces and dots, 200 characters at most; else 'document'.

    Compatibility forms are not folded here; ``functions.normal_form`` does that.
    """
    last = F.element_at(F.split(F.rtrim(F.replace(raw, F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)
    safe = F.regexp_replace(last, "[\\x00-\\x1f\\x7f-\\x9f\\u202a-\\u202e\\u2066-\\u2069]", "")
    return F.coalesce(F.nullif(F.substring(F.btrim(safe, F.lit(" .")), 1, 200), F.lit("")), F.lit("document"))


def redact(line: Column) -> Column:
    """Secrets replaced; labels and quotes of labelled ones stay, so JSON lines still parse."""
    labelled = "(?i)([\"']?\\b(?:" + "|".join(SECRET_LABELS) + ")\\b[\"']?\\s*[:=]\\s*[\"']?)[^\"'\\r\\n,}\\]]+"
    out = F.regexp_replace(line, labelled, "$1" + REDACTED.replace("[", "\\[").replace("]", "\\]"))
    for pattern in SECRET_FORMS:
        out = F.regexp_replace(out, pattern, REDACTED)
    out = F.regexp_replace(out, r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/\-]{8,}=*", "$1" + REDACTED)
    return F.regexp_replace(out, r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", REDACTED)


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def amount_text(value: Column) -> Column:
    """Two decimals, half to even, thousands parted; null is 'null'."""
    return F.coalesce(F.format_number(F.bround(value, 2), 2), F.lit("null"))


def preview(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("… [truncated "), (F.length(text) - most).cast("string"), F.lit(" chars]"))).otherwise(text)
