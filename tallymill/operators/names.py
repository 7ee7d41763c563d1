"""Which keys are alike: a join by token-set ratio that finds every pair and compares few.

Keys come as distinct rows. A pair reaches the limit in one of two ways, and each has an index with a prefix filter:

* one key's words are, but for a few letters, among the other's. Then they share one of its rarest words: as many of these are looked up
  as hold more letters than may be missing.
* what either has of its own differs by few letters. Padded with blanks, a key's pairs of letters are those of its words, in whatever order, so words that both have cancel out, and each letter added or dropped changes
  three pairs at most. Two lengths tell how many letters may differ (an even number if the lengths are both odd or both even), and so how many pairs, ``s``, two keys of these lengths share. Then of all but ``s - k`` of either's
  pairs, the rarest, they share ``k``: keys are looked up, apart for each two lengths that occur, by every ``k`` of these together. ``k`` is the cheapest (``_plan``): the more keys, the more pairs of letters it takes until few meet that aren't alike,
  so what is looked up grows little faster than the keys.

What meets is compared by ``token_ratio``. Nothing is capped; a word or pair of letters that many keys have is among the rarest of few of them.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import bound
from ..functions.similarity import token_ratio, tokens
from ..sources.tables import dealt, written

#: Below this ratio keys may share no pair of letters.
LEAST = 67.0
#: Most pairs of letters that are looked up together.
MOST = 6
#: What a meeting costs, as part of what a row costs: it compares two numbers and is dealt no further unless these are near.
MEETING = 1 / 8
#: How often a word occurs, before it, so that the rarest sorts first.
_RANK = "0" * 18


def _rarest_first(rows: DataFrame) -> DataFrame:
    """Rows with their words as text that sorts the rarest first."""
    each = rows.select("key", F.explode("words").alias("word"))
    ranked = each.join(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word").select("key", F.concat(F.lpad(F.col("n").cast("string"), len(_RANK), "0"), "word").alias("ranked"))
    return ranked.groupBy("key").agg(F.array_sort(F.collect_list("ranked")).alias("ranked")).withColumn("length", F.length(F.array_join(tokens(F.col("key")), " ")))


def _grams(key: Column) -> Column:
    """Hashes of pairs of neighbouring letters of the words with a blank on either side, numbered where they repeat."""
    padded = F.concat(F.lit(" "), F.array_join(key, " "), F.lit(" "))
    pairs = bound(padded, lambda text: F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2))))
    return bound(pairs, lambda all_: F.transform(all_, lambda p, i: F.xxhash64(p, F.size(F.filter(F.slice(all_, F.lit(1), i + 1), lambda q: q == p)))))


def _together(rare: Column, k: Column) -> Column:
    """Hashes of every ``k`` (1 to ``MOST``) of the hashes: what they have by exclusive or."""
    return bound(rare, lambda hashes: _combined(hashes, k))


def _combined(rare: Column, k: Column) -> Column:
    upto = lambda first, last: F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    def more(so_far: Column | None, first: Column, left: int) -> Column:
        with_ = lambda h: h if so_far is None else so_far.bitwiseXOR(h)
        if left == 1:
            return F.transform(F.slice(rare, first + 1, F.size(rare) - first), with_)
        return F.flatten(F.transform(upto(first, F.size(rare) - left), lambda i: more(with_(F.get(rare, i)), i + 1, left - 1)))

    out = more(None, F.lit(0), MOST)
    for n in range(MOST - 1, 0, -1):
        out = F.when(k == n, more(None, F.lit(0), n)).otherwise(out)
    return out


def _plan(lengths: dict[int, int], share: float, alike: float, asked: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """length, low, high, k, prefix: for keys of a length, with which other length (low and high are the two) they are held by how many pairs of letters of how many.

    lengths: how many keys have each; alike: the chance that two pairs of letters are equal; asked: which part of the keys is asked about. The cheapest ``k`` makes the fewest rows and chance meetings.
    """
    found, longest = [], sorted(lengths)
    for low in longest:
        for high in longest:
            if high < low or high - low > share * (low + high) + 1e-9:
                continue
            differ = int(share * (low + high) + 1e-9)
            differ -= (differ - low - high) % 2
            shared = max(1, (low + high + 2 - 3 * differ) // 2)
            ends = {low, high}
            cost = {}
            for k in range(1, min(MOST, shared) + 1):
                rows = sum(lengths[n] * comb(n + 1 - shared + k, k) for n in ends)
                cost[k] = rows + MEETING * min(1.0, 2 * asked) * lengths[low] * lengths[high] * comb(low + 1 - shared + k, k) * ((high + 1 - shared + k) * alike) ** k
            k = min(cost, key=cost.get)
            found += [(n, low, high, k, n + 1 - shared + k) for n in sorted(ends)]
    return found


#: Bits of what is dealt beside a key's number: its side of a meeting (2 bits), how many pairs of letters may differ (6), whether it is asked about.
_SIDE, _DIFFER, _BITS = 4, 64, 9


def _signature(grams: Column) -> Column:
    """A bit for each pair of letters, of 64: keys that differ by few pairs differ by no more bits."""
    return F.aggregate(grams, F.lit(0).cast("long"), lambda bits, g: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(g, F.lit(64)).cast("int"))))


def similar(keys: DataFrame, least: float) -> DataFrame:
    """key, other, similarity for all pairs of different keys with a token-set ratio of ``least`` or more, each pair both ways.

    keys: distinct rows (key, and asked, a boolean, if only pairs are wanted that hold a key that is asked about: of others not all are given). Null keys and those without words are like no other. least: above ``LEAST``, else an error.
    """
    if least <= LEAST:
        raise ValueError(f"keys are told apart by letters above a ratio of {LEAST}")
    share = 1 - least / 100
    words = lambda x: tokens(F.col(x))
    every = "asked" not in keys.columns
    keys = keys if not every else keys.withColumn("asked", F.lit(True))
    rows = dealt(written(keys.where("key is not null").select("key", "asked", words("key").alias("words")), "keys").where(F.size("words") > 0))
    # one's words among the other's: letters of its own that a key may have, at most
    spare = F.greatest(F.lit(0), F.floor((share * (2 * F.col("length") - 1) - 1) / (1 + share) + 1e-9))
    by_word = _rarest_first(rows).withColumn("spare", spare)
    upto = lambda i: F.aggregate(F.slice("ranked", F.lit(1), i), F.lit(-1), lambda n, w: n + F.length(w) - len(_RANK) + 1)  # noqa: E731  the first words with blanks between them
    prefix = F.filter("ranked", lambda w, i: (i == 0) | (upto(i) <= F.col("spare")))
    looked = by_word.select(F.col("key").alias("a"), F.explode(prefix).alias("word"))
    held = by_word.select(F.col("key").alias("b"), F.explode("ranked").alias("word"))
    within = looked.join(held, "word").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # a few letters differ
    each = rows.select("key", "asked", F.explode(_grams(F.col("words"))).alias("gram"))
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    by_gram = each.join(counts, "gram").groupBy("key", "asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda g: g["gram"]).alias("grams"))
    by_gram = written(by_gram.select("*", F.monotonically_increasing_id().alias("id")), "grams").withColumn("length", F.size("grams") - 1)
    spread = counts.agg(F.coalesce(F.sum(F.col("n").cast("double") ** 2) / F.sum("n") ** 2, F.lit(1.0)).alias("alike")).first()["alike"]
    found = by_gram.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).collect()  # as many rows as there are lengths
    lengths = {r["length"]: r["n"] for r in found}
    plan = keys.sparkSession.createDataFrame(_plan(lengths, share, spread, sum(r["asked"] for r in found) / max(1, sum(lengths.values()))), "length int, low int, high int, k int, prefix int")
    asked = dealt(by_gram).join(F.broadcast(plan), "length")
    rare = F.slice("grams", F.lit(1), F.col("prefix"))
    # what is dealt is as small as can be, three numbers: keys come back by their numbers for the few that meet and may be alike
    low, high = F.col("low"), F.col("high")
    side = F.when(low == high, 0).when(F.col("length") == low, 1).otherwise(2)
    differ = F.floor(share * (low + high) + 1e-9).cast("int")
    differ = F.least(F.lit(_DIFFER - 1), low + high + 2 - 2 * F.greatest(F.lit(1), F.floor((low + high + 2 - 3 * (differ - F.pmod(differ - low - high, F.lit(2)))) / 2).cast("int")))
    mark = F.col("id") * (1 << _BITS) + (F.when(F.col("asked"), 1).otherwise(0) * _DIFFER + differ) * _SIDE + side
    looked = asked.select(mark.alias("mark"), _signature(F.col("grams")).alias("bits"), "low", "high", F.explode(_together(rare, F.col("k"))).alias("hash"))
    looked = looked.select("mark", "bits", F.xxhash64("hash", "low", "high").alias("hash"))
    is_asked = lambda c: F.col(c).bitwiseAND(_DIFFER * _SIDE) > 0
    left, right = (looked.select(F.col("mark").alias(x), F.col("bits").alias(f"{x}_bits"), "hash") for x in ("a", "b"))
    left = left if every else left.where(is_asked("a"))
    sides = F.col("a").bitwiseAND(_SIDE - 1) + F.col("b").bitwiseAND(_SIDE - 1)
    most = F.call_function("shiftright", F.col("a"), F.lit(2)).bitwiseAND(_DIFFER - 1)
    number = lambda c: F.call_function("shiftright", F.col(c), F.lit(_BITS))
    # each condition names both sides, so that they stay alike and are worked out once
    meet = ((sides == 0) & (F.col("a").bitwiseAND(_SIDE - 1) == F.col("b").bitwiseAND(_SIDE - 1)) | (sides == 3)) & ((F.col("a") < F.col("b")) | ~(is_asked("a") & is_asked("b")))
    meet = meet & (F.col("a") != F.col("b")) & ((most == _DIFFER - 1) | (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= most))
    met = left.join(right, "hash").where(meet).select(number("a").alias("a_id"), number("b").alias("b_id")).dropDuplicates()
    met = written(met, "met")  # small, and its size tells how to bring keys back
    named = lambda x: by_gram.select(F.col("id").alias(f"{x}_id"), F.col("key").alias(x), F.col("length").alias(f"{x}_length"))
    close = met.join(named("a"), "a_id").join(named("b"), "b_id")
    # to change letters takes no more steps than to drop and add them, and this is sooner known
    own_a, own_b = (F.array_join(F.array_except(words(x), words(y)), " ") for x, y in (("a", "b"), ("b", "a")))
    steps = F.floor(share * (F.col("a_length") + F.col("b_length")) + 1e-9)
    close = close.where(F.levenshtein(own_a, own_b) <= steps).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # written, lest the ratio's limit be pushed into the joins and every meeting be compared
    pairs = dealt(written(close.union(within).dropDuplicates(["a", "b"]), "pairs")).select("a", "b", words("a").alias("a_words"), words("b").alias("b_words"))
    found = pairs.select("a", "b", token_ratio(F.col("a_words"), F.col("b_words")).alias("similarity")).where(F.col("similarity") >= least)
    ways = F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("other")), F.struct(F.col("b").alias("key"), F.col("a").alias("other")))).alias("way")
    return found.select(ways, "similarity").select("way.key", "way.other", "similarity")
