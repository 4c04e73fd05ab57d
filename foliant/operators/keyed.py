"""Rule operators over keyed rows, set at a time: each takes DataFrames with a key and an order, and returns findings rows.

All are joins, windows and aggregations by key; the keys are documents, orders, users and the like, so groups are small
against the table, and partial aggregation comes before every shuffle where the operator allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def detail_vs_total(details: DataFrame, totals: DataFrame, key: str, amount: Column, total: Column, tolerance: str = "0.01") -> DataFrame:
    """Keys whose details, summed, differ from the total by more than the tolerance: key, detail_sum, total, gap. Sums are decimal."""
    exact = lambda c: c.cast("decimal(20,4)")
    summed = details.groupBy(key).agg(F.sum(exact(amount)).cast("decimal(24,4)").alias("detail_sum"))
    joined = totals.select(key, exact(total).alias("total")).join(summed, key)
    gap = (F.col("detail_sum") - F.col("total")).cast("decimal(24,4)")
    return joined.withColumn("gap", gap).where(F.abs("gap") > F.lit(tolerance).cast("decimal(10,4)"))


def shares_over_cap(rows: DataFrame, key: str, category: str, amount: Column, caps: dict[str, float]) -> DataFrame:
    """(key, category) pairs whose share of the key's sum is above the category's cap: key, category, part, whole."""
    parts = rows.groupBy(key, category).agg(F.sum(amount.cast("decimal(20,4)")).cast("decimal(24,4)").alias("part"))
    whole = F.sum("part").over(Window.partitionBy(key)).cast("decimal(24,4)")
    cap = F.coalesce(*[F.when(F.col(category) == c, F.lit(str(x)).cast("decimal(10,4)")) for c, x in caps.items()])
    return parts.withColumn("whole", whole).where((F.col("whole") > 0) & (F.col("part") > cap * F.col("whole")))


def numbering_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Numbers that are missing in 1..max of each key: key, missing (sorted, joined by commas). Keys without a gap give no row."""
    seen = rows.where(F.col(number).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(number)).alias("seen"))
    missing = F.array_except(F.sequence(F.lit(1), F.array_max("seen").cast("int")), F.col("seen").cast("array<int>"))
    return seen.where(F.array_max("seen") > F.size("seen")).select(key, F.array_join(missing.cast("array<string>"), ",").alias("missing"))


def sequence_breaks(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Places where a key's sorted numbers don't rise by one: key, before, after."""
    w = Window.partitionBy(key).orderBy(number)
    return rows.select(key, F.lag(number).over(w).alias("before"), F.col(number).alias("after")).where("after != before + 1")


def first_order_drop(rows: DataFrame, key: str, item: str, order: list, expected: list[str]) -> DataFrame:
    """Of each key the first item that comes after one that should follow it: key, item, position (1-based in expected).

    Items count where they first come up; those not expected don't count.
    """
    position = F.coalesce(*[F.when(F.col(item) == x, F.lit(i)) for i, x in enumerate(expected)])
    first = rows.where(F.col(item).isin(expected)).groupBy(key, item).agg(F.min(F.struct(*order)).alias("at")).withColumn("position", position)
    w = Window.partitionBy(key).orderBy("at")
    drops = first.withColumn("drop", F.col("position") < F.lag("position").over(w)).where("drop")
    return drops.groupBy(key).agg(F.min_by(F.struct(item, "position"), "at").alias("x")).select(key, f"x.{item}", (F.col("x.position") + 1).alias("position"))


def missing_items(rows: DataFrame, key: str, item: str, expected: list[str]) -> DataFrame:
    """(key, missing item) for each expected item that a key of rows lacks: an anti join without the join."""
    seen = rows.groupBy(key).agg(F.collect_set(F.when(F.col(item).isin(expected), F.col(item))).alias("seen"))
    return seen.select(key, F.explode(F.array_except(F.array(*map(F.lit, expected)), "seen")).alias("missing"))


def neighbourhood(rows: DataFrame, key: str, order: list, hit: Column, value: str, reach: int = 2) -> DataFrame:
    """For each hit row the least and most value among itself and the `reach` rows on either side."""
    o = Window.partitionBy(key).orderBy(*order)
    w = o.rowsBetween(-reach, reach)
    return rows.select("*", F.min(value).over(w).alias("near_min"), F.max(value).over(w).alias("near_max"), F.count("*").over(w).alias("near_rows")).where(hit)


def disagreements(rows: DataFrame, key: str, value: str, least: int = 2) -> DataFrame:
    """Keys with at least `least` occurrences whose values aren't all the same: key, occurrences, distinct_values, low, high."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("occurrences"), F.countDistinct(value).alias("distinct_values"), F.min(value).alias("low"), F.max(value).alias("high")).where((F.col("occurrences") >= least) & (F.col("distinct_values") > 1))


def mode_first_seen(rows: DataFrame, key: str, value: str, order: list) -> DataFrame:
    """Of each key the most frequent value; among equally frequent ones that seen first: key, mode, times."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("times"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("times"), "first")
    return counts.withColumn("rank", F.row_number().over(w)).where("rank = 1").select(key, F.col(value).alias("mode"), "times")


def first_copies(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Distinct contents by SHA-256, with the first row that has each: sha256, first, copies."""
    return rows.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(order).alias("first"), F.count("*").alias("copies"))


def latest_per_key(rows: DataFrame, key: str, order: list[str], *values: str) -> DataFrame:
    """Of each key the values of its latest row: an aggregation with map-side combine, no window."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("x")).select(key, "x.*")


def most_recent(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The n latest rows (n is held between 1 and 200): a top-k, not a sort."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(max(1, min(n, 200)))


def stale(rows: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Rows after which a key is idle for longer than `seconds`: key, at, idle_seconds. The last row of a key isn't judged."""
    w = Window.partitionBy(key).orderBy(at)
    idle = F.lead(F.unix_micros(F.col(at).cast("timestamp"))).over(w) - F.unix_micros(F.col(at).cast("timestamp"))
    return rows.select(key, at, (idle / 1_000_000).cast("long").alias("idle_seconds"), idle.alias("micros")).where(F.col("micros") > seconds * 1_000_000).drop("micros")


def section_sizes(blocks: DataFrame, key: str, order: str, level: str, size: str) -> DataFrame:
    """Of each heading (level not null) the summed size of what follows it, up to the next heading of its level or above.

    A heading of level l ends with the next heading of level <= l. For the few levels there are, a running count of headings of
    level <= l numbers the sections, so that windows and one aggregation do without a range join.
    """
    levels = (1, 2, 3, 4, 5, 6)
    w = Window.partitionBy(key).orderBy(order)
    numbered = blocks.select(key, order, level, size, *[F.sum(F.when(F.col(level) <= x, 1).otherwise(0)).over(w).alias(f"s{x}") for x in levels])
    parts = numbered.select(key, order, level, size, F.explode(F.array(*[F.struct(F.lit(x).alias("of"), F.col(f"s{x}").alias("section")) for x in levels])).alias("p"))
    own = (F.col(level) == F.col("p.of"))
    agg = parts.where("p.section > 0").groupBy(key, F.col("p.of").alias("of"), F.col("p.section").alias("section")).agg(F.sum(F.when(own & F.col(level).isNotNull(), 0).otherwise(F.col(size))).alias("size"), F.min(F.when(own, F.col(order))).alias("heading"), F.min(F.col(order)).alias("first"))
    return agg.where("heading = first").select(key, "heading", F.col("of").alias("level"), "size")


def heading_faults(rows: DataFrame, key: str, order: str, level: str, number: str) -> DataFrame:
    """Numbered headings that jump a level or don't go on from their predecessor: key, order, fault, expected.

    The state of a fold over headings, in windows: a level's last number is forgotten when a shallower heading comes.
    """
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("prev_level", F.lag(level).over(w))
    shallower = r.select("*", *[F.sum(F.when(F.col(level) < x, 1).otherwise(0)).over(w).alias(f"g{x}") for x in (1, 2, 3)])
    group = F.coalesce(*[F.when(F.col(level) == x, F.col(f"g{x}")) for x in (1, 2, 3)])
    grouped = shallower.withColumn("group", group)
    last = F.lag(number).over(Window.partitionBy(key, level, "group").orderBy(order))
    faults = grouped.withColumn("last", last).withColumn(
        "fault", F.when(F.col(level) > F.coalesce("prev_level", F.lit(0)) + 1, "level_jump").when(F.col(number) != F.coalesce("last", F.lit(0)) + 1, "discontinuity")
    )
    return faults.where("fault is not null").select(key, order, "fault", (F.coalesce("last", F.lit(0)) + 1).alias("expected"))


def instance_match(expected: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """True and false positives and false negatives of each group, as counts alone; metrics.instance_pairs says which they are."""
    counted = lambda df, side: df.groupBy(*group).agg(F.count("*").alias(side))
    both = counted(expected, "e").join(counted(predicted, "p"), group, "full")
    e, p = F.coalesce("e", F.lit(0)), F.coalesce("p", F.lit(0))
    return both.select(*group, F.least(e, p).alias("tp"), F.greatest(p - e, F.lit(0)).alias("fp"), F.greatest(e - p, F.lit(0)).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 in millionths of 1; null where a denominator is 0."""
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def batch_rollup(items: DataFrame, batch: str, status: str, terminal: list[str]) -> DataFrame:
    """total, done_count and state of each batch; a batch is done when all its items are in a terminal status."""
    done = F.sum(F.when(F.col(status).isin(terminal), 1).otherwise(0))
    return items.groupBy(batch).agg(F.count("*").alias("total"), done.alias("done_count")).withColumn("state", F.when(F.col("done_count") == F.col("total"), "done").otherwise("running"))


def retention_candidates(owners: DataFrame, tasks: DataFrame, key: str, active: Column, used: Column, cutoff: Column) -> DataFrame:
    """Owners without an active task whose last use lies before the cutoff (or who have none): key, last_use."""
    seen = tasks.groupBy(key).agg(F.bool_or(active).alias("active"), F.max(used).alias("last_use"))
    return owners.select(key).join(seen, key, "left").where(~F.coalesce("active", F.lit(False)) & (F.col("last_use").isNull() | (F.col("last_use") < cutoff))).select(key, "last_use")
