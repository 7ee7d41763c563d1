"""The join of similar keys against all pairs."""

import random
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F
from tallymill.operators import names, screening

from .test_functions import ratio

WORDS = ["gulf", "trading", "metals", "al", "noor", "general", "star", "north", "print", "house", "cedar", "works", "x"]


def many(n, seed=2):
    rng = random.Random(seed)
    words = WORDS + ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0") for _ in range(rng.randint(2, 9))) for _ in range(n // 8)]
    found = {"long " + "ab" * 60, "long " + "ab" * 60 + "c", "", "trading"}
    while len(found) < n:
        key = " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        found.add(key)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(key))
            key = " ".join((key[:at] + rng.choice(["", "e", " ", key[at] + "q"]) + key[at + 1 :]).split()) or "k"
        found.add(key)
    return sorted(found)


@pytest.mark.parametrize(("least", "n"), [(88.0, 2000), (75.0, 400)])
def test_all_pairs_are_found(spark, least, n):
    keys = many(n)
    found = {(r["key"], r["other"]): r["similarity"] for r in names.similar(spark.createDataFrame([(k,) for k in [*keys, None]], "key string"), least).collect()}
    bags = {k: Counter("".join(set(k.split()))) for k in keys}
    words = {k: set(k.split()) for k in keys}
    size = lambda x: sum(map(len, x)) + len(x) - 1
    want = {}
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            # most pairs can't be alike: too many letters differ, and too many words are not shared
            differ = sum(((bags[a] - bags[b]) | (bags[b] - bags[a])).values())
            own = min(size(words[a] - words[b]), size(words[b] - words[a]))
            if differ <= (1 - least / 100) * (size(words[a]) + size(words[b])) + 1e-9 or own < size(words[a] & words[b]):
                r = ratio(a, b)
                if r >= least - 1e-9:
                    want[a, b] = want[b, a] = r
    assert set(found) == set(want) and len(found) > 200
    assert all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_few_pairs_are_compared(spark):
    """A word that nearly all keys have brings no pairs together."""
    keys = spark.range(3000).select(F.concat(F.translate(F.md5(F.col("id").cast("string").cast("binary")), "0123456789", "ghijklmnop"), F.lit(" trading")).alias("key"))
    assert names.similar(keys, 88.0).count() == 0
    plan = names.similar(keys, 88.0)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_limits_and_odd_names(spark):
    with pytest.raises(ValueError):
        names.similar(spark.createDataFrame([], "key string"), 60.0)
    assert names.similar(spark.createDataFrame([], "key string"), 88.0).collect() == []
    asked = spark.createDataFrame([(1, "gulf metals"), (2, None), (3, "")], "a long, name_a string")
    others = spark.createDataFrame([(1, "gulf metals"), (5, "gulf metals"), (6, "metals gulf co"), (7, None), (8, "")], "b long, name_b string")
    assert {(r["a"], r["b"], r["ratio"]) for r in screening.similar_names(asked, others).collect()} == {(1, 5, 100.0), (1, 6, 100.0)}


def test_what_is_looked_up_grows_with_the_keys():
    """A hundred times the keys of a length make little more than a hundred times the rows and chance meetings."""
    def cost(n):
        return sum(n * comb(p, k) + n * n * comb(p, k) * (p * 0.004) ** k / 2 for *_, k, p in names._plan({15: n}, 0.12, 0.004))

    assert cost(10**6) < 300 * cost(10**4)
    assert [x[:3] for x in names._plan({15: 5, 12: 1, 11: 1, 19: 2}, 0.12, 0.004)] == [(11, 11, 11), (11, 11, 12), (12, 11, 12), (12, 12, 12), (12, 12, 15), (15, 12, 15), (15, 15, 15), (15, 15, 19), (19, 15, 19), (19, 19, 19)]


def test_ratios_are_worked_out_after_the_join(spark):
    """The ratio's limit isn't pushed into the join, where it would be asked of every meeting."""
    keys = spark.range(50).select(F.concat(F.lit("gulf metals "), F.col("id").cast("string")).alias("key"))
    assert "Join" not in names.similar(keys, 88.0)._jdf.queryExecution().optimizedPlan().toString()


def test_only_keys_asked_about_are_paired(spark):
    """Either side may be asked about; other pairs may be left out, but none of these is lost, and less is looked up."""
    keys = many(600, seed=4)
    every = {(r["key"], r["other"]): r["similarity"] for r in names.similar(spark.createDataFrame([(k,) for k in keys], "key string"), 88.0).collect()}
    asked = set(keys[::7])
    rows = names.similar(spark.createDataFrame([(k, k in asked) for k in keys], "key string, asked boolean"), 88.0).collect()
    assert {(r["key"], r["other"]): r["similarity"] for r in rows if r["key"] in asked or r["other"] in asked} == {k: v for k, v in every.items() if asked & set(k)}
    cost = lambda part: sum(comb(p, k) for *_, k, p in names._plan({15: 10**6, 19: 10**6}, 0.12, 0.004, part))
    assert cost(0.05) < 0.8 * cost(1.0)


def test_signatures_hold_pairs_of_letters(spark):
    """Keys of few unlike letters have signatures of few unlike bits."""
    rows = [r["key"] for r in spark.createDataFrame([("gulf metals",), ("gulf metal",)], "key string").collect()]
    found = spark.createDataFrame([(k.split(" "),) for k in rows], "words array<string>").select(names._signature(names._grams(F.col("words"))).alias("s")).collect()
    assert 0 < ((found[0]["s"] ^ found[1]["s"]) & (2**64 - 1)).bit_count() <= 3
