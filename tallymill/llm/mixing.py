"""Operator 3: mixing sources to target weights, by Efraimidis-Spirakis sampling in DataFrame functions alone.

A document's size is its number of words, runs of characters other than space and \\x09-\\x0D. The
sources, by code point and null last, weigh 1, 2, 3, 1, 2, 3 ... and share the words of all sources;
no target passes ``most_repeats`` times its source's size, and what is above is shared again by weight.

A target's whole multiples of the source are complete epochs: every document so often. The rest of the
target is drawn without replacement: each document has the key -ln(u) / quality, u from the md5 of its
doc_id, and the documents of a source are taken in the order of their keys until their summed sizes
reach the rest; the last one gives its first words only, so that a source takes its target to the word.

Quality is a column that the caller names, or the share of letters among the characters that aren't white space. Documents whose quality is null, NaN, zero or negative
are drawn after all others.

Cases: null or empty text has size 0, a key like any other, and takes 0. A null source is a source of
its own, the last. A null doc_id is drawn by the text "null". Equal keys (repeated doc_ids) are ordered by doc_id,
then size; of rows alike in all of these each takes its own part of what falls to them, in any order. An empty table gives no
rows. Other columns of the input are left out by ``mix`` and kept by ``apply_mix``.

Scale: the text is read once, to a table of some 40 bytes a document. Prefix sums need no partition of a
whole source: rows are range-partitioned by (source, key), each partition's sums are themselves summed,
and a row's sum starts at its partition's. Sources are ranked and their limits summed the same way, so no task gets all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, materialise

WORD = r"[^\x20\x09-\x0D]+"
MOST_REPEATS = 3
#: Stands for no quality: keys beyond those of any that is larger.
NO_QUALITY = 1e-300


def letter_share() -> Column:
    """The share of letters among the characters that aren't white space, of column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    solid = F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return (letters + 1) / (solid + 1)


def measured(docs: DataFrame, quality: Column | None = None, *keep: Column) -> DataFrame:
    """doc_id, source, size, quality (a positive column; by default ``letter_share``), and ``keep``."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"), (letter_share() if quality is None else quality).alias("quality"), *keep)


def in_ranges(rows: DataFrame, order: list[Column], name: str, *sums: Column) -> DataFrame:
    """Rows with running sums in an order of all of them: range-partitioned by it, summed within parts, and from the sums of the parts before.

    Only one row a part meets in one task. sums: named columns; they are replaced by their sums over the rows up to their own.
    """
    names = [rows.select(c).columns[0] for c in sums]
    keys = [f"o{i}" for i in range(len(order))]
    ranged = rows.select("*", *(c.alias(f"_{n}") for c, n in zip(sums, names, strict=True))).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, name)
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    firsts = ranged.groupBy("part").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in names)).select("part", *(F.coalesce(F.sum(f"_{n}").over(every), F.lit(0)).alias(f"first_{n}") for n in names))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *(F.sum(f"_{n}").over(inside).alias(f"in_{n}") for n in names)).join(firsts, "part")
    return summed.select(*rows.columns, *((F.col(f"first_{n}") + F.col(f"in_{n}")).alias(n) for n in names)).drop(*keys)


def source_targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from one row a source (source, source_size).

    A source is at its limit if the level at which it gets there shares out no more than there is; so are all that get there at lower levels.
    """
    ranked = in_ranges(sizes, [F.col("source").asc_nulls_last()], "ranked", F.lit(1).cast("long").alias("nth"))
    ranked = ranked.select("source", "source_size", ((F.col("nth") - 1) % 3 + 1).alias("weight")).withColumn("most", F.col("source_size") * most_repeats)
    ranked = materialise(ranked.withColumn("limit_level", F.col("most") / F.col("weight")), "levels")
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = (F.lit(x or 0).cast("long") for x in whole)
    levels = in_ranges(ranked.groupBy("limit_level").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight")), [F.col("limit_level")], "upto", F.col("most").alias("most_upto"), F.col("weight").alias("weight_upto"))
    last = levels.where(F.col("most_upto") + F.col("limit_level") * (weight - F.col("weight_upto")) <= size).agg(F.max("limit_level")).first()[0]
    limited = F.lit(False) if last is None else F.col("limit_level") <= F.lit(last)
    rest = ranked.agg(F.sum(F.when(limited, F.col("most"))).alias("most"), F.sum(F.when(~limited, F.col("weight"))).alias("weight")).first()
    spare = F.lit((whole["size"] or 0) - (rest["most"] or 0)).cast("long")
    share = F.when(limited, F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), spare * F.col("weight") / F.lit(rest["weight"]).cast("long")))
    return ranked.select("source", "source_size", share.alias("target"))


def draw_key(doc_id="doc_id", quality="quality"):
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("double") + 1) / F.lit(float(2**52))
    q = F.col(quality).cast("double")
    return -F.ln(u) / F.when((q > 0) & ~F.isnan(q), q).otherwise(NO_QUALITY)


def mix(docs: DataFrame, most_repeats: int = MOST_REPEATS, quality: Column | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source, quality."""
    rows = materialise(measured(docs, quality), "sizes")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most_repeats)
    ranged = rows.withColumn("key", draw_key()).repartitionByRange(F.col("source"), F.col("key"), F.col("doc_id"), F.col("size"))
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    parts = parts.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "part", "part_start", "source_size", "target")
    inside = Window.partitionBy("part", "source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = summed.alias("r").join(parts.alias("p"), (F.col("r.part") == F.col("p.part")) & F.col("r.source").eqNullSafe(F.col("p.source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.floor(F.col("target") - epochs * F.col("source_size") + 0.5)
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("part_start") - F.col("inside")))
    return joined.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), F.col("r.source").alias("source"), F.round("quality", 9).alias("quality"))


def apply_mix(docs: DataFrame, most_repeats: int = MOST_REPEATS, quality: Column | None = None) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last time perhaps its first words alone; the columns of ``docs``.

    Rows alike in doc_id, source and size mostly take the same. Where the end of a target falls among them, they are numbered: the first take one time more, one what is left.
    """
    alike = mix(docs, most_repeats, quality).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"), F.max("taken").alias("most"), F.min("taken").alias("least"), F.sum("taken").alias("all"))
    # most documents are taken once or as often as all of their source: only ids and counts are joined, by broadcast while they are few
    alike = materialise(alike.where("most > 0"), "taken")
    sized = measured(docs, quality, F.struct(*docs.columns).alias("doc")).alias("d")
    on = F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.size") == F.col("t.size"))
    both = sized.join(broadcast_if_small(alike.where("least = most")).alias("t"), on).select("d.size", F.col("most").alias("taken"), "doc")
    parted = alike.where("least < most")  # one for each source at most
    if not parted.isEmpty():
        rows = sized.join(F.broadcast(parted).alias("t"), on).select("d.doc_id", "d.source", "d.size", "least", "all", "n", "doc", F.xxhash64(F.monotonically_increasing_id()).alias("spread"))
        order = [F.col(c) for c in ("source", "doc_id", "size", "spread")]
        numbered = materialise(in_ranges(rows, order, "parted", F.lit(1).cast("long").alias("nth")), "numbered")
        first = numbered.groupBy("source", "doc_id", "size").agg((F.min("nth") - 1).alias("before"))
        on = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.size") == F.col("f.size"))
        rows = numbered.alias("r").join(F.broadcast(first).alias("f"), on).withColumn("own", F.col("nth") - F.col("before"))
        fewer = F.floor(F.col("least") / F.col("r.size")) * F.col("r.size")  # what all of them take
        more = F.floor((F.col("all") - F.col("n") * fewer) / F.col("r.size"))  # so many take one time more
        taken = fewer + F.when(F.col("own") <= more, F.col("r.size")).when(F.col("own") == more + 1, F.col("all") - F.col("n") * fewer - more * F.col("r.size")).otherwise(0)
        both = both.union(rows.select("r.size", taken.cast("long").alias("taken"), "doc").where("taken > 0"))
    times = F.ceil(F.col("taken") / F.col("size"))
    copies = both.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    words = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col("doc.text")
    cut = F.when(words >= F.col("size"), text).otherwise(F.array_join(F.slice(F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), F.lit(1), F.greatest(words, F.lit(1)).cast("int")), ""))
    out = copies.select(F.struct(*(cut.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns)).alias("doc"))
    return out.select(*(F.length("doc.text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))


ORACLE_SQL = r"""
WITH measured AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (length(regexp_replace(coalesce(text, ''), '[^\p{L}]+', '', 'g')) + 1) / CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) + 1 AS DOUBLE) AS quality
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM measured GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sizes),
levels AS (SELECT *, 3 * source_size AS most, 3 * source_size / CAST(weight AS DOUBLE) AS limit_level FROM ranked),
summed AS (
  SELECT *, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight,
    sum(most) OVER (ORDER BY limit_level) AS most_upto, sum(weight) OVER (ORDER BY limit_level) AS weight_upto FROM levels),
marked AS (SELECT *, most_upto + limit_level * (all_weight - weight_upto) <= all_size AS limited FROM summed),
targets AS (
  SELECT source, source_size, CASE WHEN limited THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE),
      CAST(all_size - coalesce(sum(CASE WHEN limited THEN most END) OVER (), 0) AS DOUBLE) * weight / sum(CASE WHEN NOT limited THEN weight END) OVER ()) END AS target
  FROM marked),
keyed AS (
  SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE) / quality AS draw FROM measured),
before AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM keyed),
joined AS (
  SELECT b.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs
  FROM before b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 0.5) - earlier)) AS BIGINT) AS taken, source, round(quality, 9) AS quality
FROM joined
"""
