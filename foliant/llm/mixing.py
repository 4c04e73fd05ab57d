"""Mixing sources to target weights (7), in DataFrame operations only.

Systematic sampling. Each document of a source is expected target / source_size times. Within the source the documents stand
in the order of their sizes, so that the sum of the copies' sizes stays near the target; each gets the interval of prefix
sums of expected copies that it covers, moved by one random offset of the source, and is emitted once for each integer in it.

The order is cut into groups (source, size, part), where part is a hash of the document: prefix sums over the groups' counts
give where each group starts, and only a group's own rows are numbered together. So neither a hot source nor a large group of
copies meets in one task.

Defined results. Null or empty text: size 0. A null source is a source of its own, the last. A source without words has
target 0, and its documents are taken 0 times. Equal rows are numbered in an arbitrary order, which doesn't change the
result as a set of rows. An empty table gives an empty result. Columns beside text, source and doc_id stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, kept_table, key_of

#: Weights of the sources in their order, repeating; most copies; parts of a group of one size.
WEIGHTS, MOST, PARTS = (1, 2, 3), 3, 256
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def part_of(doc_id: Column) -> Column:
    """A hash of the id that SQL engines share: the high bits of a product modulo 2^31."""
    x = F.pmod(F.coalesce(doc_id, F.lit(0)).cast("long"), F.lit(1 << 31)) * F.lit(1103515245)
    return (F.shiftright(F.pmod(x, F.lit(1 << 31)), 15) % PARTS).cast("int")


def offset_of(source: Column, seed: str = SEED) -> Column:
    """One number in [0, 1) for each source, in 2^-24."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(source, F.lit("\x00null")))), 1, 6), 16, 10).cast("long") / F.lit(float(1 << 24))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of each row (source, source_size).

    The targets share the total by weight, and stop at most * source_size. Water-filling: with the sources in the order of
    source_size / weight, those that stop come first; source k stops if what remains after the stopped ones before it,
    shared by the weights from k on, is above its stop. Two running sums give this. (A window over all sources: one row each.)
    """
    by_name = Window.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.col("source"))
    numbered = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    fill = Window.partitionBy(F.lit(1)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    filled = (
        numbered.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("stops", F.col("left") * F.col("weight") > most * F.col("source_size") * F.col("rest"))
    )
    # the first that doesn't stop sets the share of all that follow
    share = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), (F.col("left") / F.col("rest")).alias("share")))).over(everything)["share"]
    return filled.withColumn("target", F.when(F.col("stops"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * share)).select("source", "source_size", "target")


def copies(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """docs with the struct column `mix`: size, source_size, target, copies.

    Each document takes `rate` = target / source_size of a copy; with `place` rows of its source before it, it is emitted
    floor(offset + rate * (place + 1)) - floor(offset + rate * place) times.
    """
    size, part, source, row = (free_name(docs, x) for x in ("mix_size", "mix_part", "mix_source", "mix_row"))
    sized = docs.withColumn(size, size_of(F.col("text"))).withColumn(part, part_of(F.col("doc_id"))).withColumn(source, key_of(F.col("source")))
    counted = kept_table(sized.groupBy(source, size, part).agg(F.count("*").alias("n"), F.first("source").alias("name")), "mix-groups")
    by_size = kept_table(counted.groupBy(source, size).agg(F.sum("n").alias("n"), F.first("name").alias("name")), "mix-sizes")
    totals = by_size.groupBy(source).agg(F.sum(F.col("n") * F.col(size)).alias("source_size"), F.first("name").alias("source"))
    of = targets(totals.select("source", "source_size"), weights, most).select(key_of(F.col("source")).alias(source), "source_size", "target")
    # two levels of prefix sums: over the sizes of a source, then over the parts of a size
    over_sizes = by_size.select(source, size, (F.sum("n").over(Window.partitionBy(source).orderBy(size)) - F.col("n")).alias("before"))
    groups = counted.select(source, size, part, (F.sum("n").over(Window.partitionBy(source, size).orderBy(part)) - F.col("n")).alias("within"))
    start = groups.join(over_sizes, [source, size]).join(of, source)
    placed = start.select(source, size, part, F.struct((F.col("before") + F.col("within")).alias("start"), "source_size", "target").alias(place := free_name(docs, "mix_place")))
    numbered = sized.withColumn(row, F.row_number().over(Window.partitionBy(source, size, part).orderBy("doc_id", F.xxhash64("text"))) - 1)
    joined = numbered.join(placed, [source, size, part])
    rate = F.when(F.col(f"{place}.source_size") > 0, F.col(f"{place}.target") / F.col(f"{place}.source_size")).otherwise(0.0)
    at = F.col(f"{place}.start") + F.col(row)
    upto = lambda n: F.floor(offset_of(F.col("source"), seed) + rate * n)
    mix = F.struct(F.col(size).alias("size"), f"{place}.source_size", f"{place}.target", (upto(at + 1) - upto(at)).cast("long").alias("copies"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], mix.alias(free_name(docs, "mix")))


def mixing_query(docs: DataFrame) -> DataFrame:
    return copies(docs.select("doc_id", "text", "source")).select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.copies") * F.col("mix.size")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: each document as often as the mix takes it."""
    mix = free_name(docs, "mix")
    return copies(docs).withColumn(mix, F.explode(F.array_repeat(F.lit(1), F.col(f"{mix}.copies").cast("int")))).drop(mix)


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    ((((((coalesce(doc_id, 0) % 2147483648) + 2147483648) % 2147483648) * 1103515245) % 2147483648) >> 15) % {PARTS} AS part, md5(text) AS t
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % {len(WEIGHTS)} + 1] AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER w, 0) AS remaining, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS rest
  FROM n WINDOW w AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, remaining * weight > {MOST} * source_size * rest AS stops FROM f),
h AS (SELECT source, source_size, CASE WHEN stops THEN ({MOST} * source_size)::DOUBLE ELSE weight * (SELECT arg_min(remaining::DOUBLE / rest::DOUBLE, source_size / weight) FROM g WHERE NOT stops) END AS target FROM g),
r AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, part, doc_id, t) - 1 AS place,
    CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5('{SEED}|' || coalesce(d.source, chr(0) || 'null')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS off
  FROM d JOIN h ON h.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, ((floor(off + rate * (place + 1)) - floor(off + rate * place)) * size)::BIGINT AS taken FROM r
"""
