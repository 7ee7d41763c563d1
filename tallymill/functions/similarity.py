"""The token-set ratio of two keys, in higher-order functions: 0 to 100, by longest common subsequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clean import bound

#: Letters in one long; the bits above take the carry.
WIDTH = 62


def _shift(one: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", one.cast("long"), bits.cast("int"))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def letter_masks(text: Column) -> Column:
    """A map from each letter to the bits of its places, in as many longs as the text needs."""

    def masks(letters: Column) -> Column:
        words = F.sequence(F.lit(0), F.ceil(F.size(letters) / WIDTH).cast("int") - 1)

        def mask(letter: Column, word: Column) -> Column:
            here = F.slice(letters, word * WIDTH + 1, F.lit(WIDTH))
            bits = F.transform(here, lambda c, i: F.when(c == letter, _shift(F.lit(1), i)).otherwise(F.lit(0).cast("long")))
            return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

        entries = F.transform(F.array_distinct(letters), lambda c: F.struct(c.alias("c"), F.transform(words, lambda w: mask(c, w)).alias("m")))
        return F.when(F.size(letters) == 0, F.create_map().cast("map<string,array<bigint>>")).otherwise(F.map_from_entries(entries))

    return bound(_letters(text), masks)


def common_subsequence(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two strings, by bits: a step for each letter of ``b`` treats ``WIDTH`` letters of ``a`` at once."""
    full = _shift(F.lit(1), F.lit(WIDTH)) - 1

    def counted(masks: Column, words: Column) -> Column:
        nothing = F.transform(words, lambda w: F.lit(0).cast("long"))

        def step(rows: Column, letter: Column) -> Column:
            mask = F.coalesce(F.try_element_at(masks, letter), nothing)

            def word(s: Column, x: Column) -> Column:
                total = x["row"] + x["row"].bitwiseAND(x["mask"]) + s["carry"]
                kept = total.bitwiseAND(full).bitwiseOR(x["row"] - x["row"].bitwiseAND(x["mask"]))
                return F.struct(F.concat(s["rows"], F.array(kept)).alias("rows"), F.call_function("shiftright", total, F.lit(WIDTH)).alias("carry"))

            start = F.struct(F.array().cast("array<bigint>").alias("rows"), F.lit(0).cast("long").alias("carry"))
            return F.aggregate(F.zip_with(rows, mask, lambda r, m: F.struct(r.alias("row"), m.alias("mask"))), start, word, lambda s: s["rows"])

        rows = F.aggregate(_letters(b), F.transform(words, lambda w: full), step)
        return F.aggregate(rows, F.lit(0), lambda n, r: n + F.lit(WIDTH) - F.bit_count(r))

    def short(masks: Column, n: Column) -> Column:
        """The same in one long."""
        own = _shift(F.lit(1), n) - 1

        def step(row: Column, letter: Column) -> Column:
            here = row.bitwiseAND(F.coalesce(F.get(F.try_element_at(masks, letter), F.lit(0)), F.lit(0).cast("long")))
            return (row + here).bitwiseOR(row - here).bitwiseAND(own)

        return n - F.bit_count(F.aggregate(_letters(b), own, step))

    n = F.length(a)
    words = F.sequence(F.lit(0), F.ceil(n / WIDTH).cast("int") - 1)
    return F.when((n == 0) | (F.length(b) == 0), F.lit(0)).otherwise(bound(letter_masks(a), lambda m: F.when(n <= WIDTH, short(m, n)).otherwise(counted(m, words))))


def tokens(key: Column) -> Column:
    """The distinct words of a key, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.split(key, " "), lambda t: t != "")))


def token_ratio(ta: Column, tb: Column) -> Column:
    """``token_set_ratio`` of keys given as their ``tokens``."""
    parts = F.struct(F.array_join(F.array_intersect(ta, tb), " ").alias("both"), F.array_join(F.array_except(ta, tb), " ").alias("a"), F.array_join(F.array_except(tb, ta), " ").alias("b"))

    def ratio(p: Column) -> Column:
        s, la, lb = F.length(p["both"]), F.length(p["a"]), F.length(p["b"])
        joint = F.when(s > 0, 1).otherwise(0)
        whole_a, whole_b = s + joint + la, s + joint + lb
        first = 1 - (la + lb - 2 * common_subsequence(p["a"], p["b"])) / (whole_a + whole_b)
        second, third = 1 - (joint + la) / (s + whole_a), 1 - (joint + lb) / (s + whole_b)
        inside = (s > 0) & ((la == 0) | (lb == 0))
        return F.when(inside, F.lit(100.0)).when(s > 0, 100 * F.greatest(first, second, third)).otherwise(100 * first)

    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), F.lit(0.0)).otherwise(bound(parts, ratio))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Tokens both have are held against either's own ones: 100 if one's tokens are among the other's, 0 if either has none."""
    return token_ratio(tokens(a), tokens(b))
