"""Evaluation of findings against what was expected, with the identity of instances."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def finding_class(confidence: Column, layer: Column) -> Column:
    """manual_required and degraded findings are counted apart from the deterministic ones."""
    return F.when(confidence == "manual_required", "manual_required").when((confidence == "degraded") | (layer == "system"), "degraded").otherwise("deterministic")


def set_match(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys: tp, fp, fn as flags of each key that either side has."""
    e, p = expected.select(*keys).distinct().withColumn("e", F.lit(1)), predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    both = e.join(p, keys, "full")
    return both.select(*keys, (F.col("e").isNotNull() & F.col("p").isNotNull()).cast("long").alias("tp"), F.col("e").isNull().cast("long").alias("fp"), F.col("p").isNull().cast("long").alias("fn"))


ORDER = ("page", "message", "rule_id")
PAIRS = "sample_id string, checker string, severity string, outcome string, expected_id long, predicted_id long, page_shifted boolean"


def _places(df: DataFrame) -> list[Column]:
    """What instances of one group are ordered by: the page as a string, the message and the rule; then their number."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"place_{c}") if c in df.columns else F.lit("").alias(f"place_{c}") for c in ORDER]


def instance_pairs(expected: DataFrame, predicted: DataFrame, group: list[str]) -> DataFrame:
    """group, n, outcome (tp, fp, fn), expected_id, predicted_id: of each group the n-th expected instance and the n-th predicted
    one are a pair, and what is left over on either side stands alone. Both have instance_id, and those of ORDER as they have them.
    Null group values count as empty."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group]

    def ranked(df: DataFrame, side: str) -> DataFrame:
        rows = df.select(*keys, *_places(df), F.col("instance_id").alias(side))
        order = Window.partitionBy(*group).orderBy(*[f"place_{c}" for c in ORDER], side)
        return rows.select(*group, side, F.row_number().over(order).cast("long").alias("n"))

    both = ranked(expected, "expected_id").join(ranked(predicted, "predicted_id"), [*group, "n"], "full")
    outcome = F.when(F.col("expected_id").isNull(), "fp").when(F.col("predicted_id").isNull(), "fn").otherwise("tp")
    return both.select(*group, "n", outcome.alias("outcome"), "expected_id", "predicted_id")


class Waiting:
    """A group's expected instances that wait for predictions, which come in order.

    Expected instances take their predictions in order, each the first one left whose text holds all its anchors. As both sides
    have one order, which all share, there is only one stable assignment, and giving each prediction to the first expected instance
    that waits and fits makes the same one. So predictions pass by, and only the expected instances are held. A prediction that
    none takes is left for the next instance without anchors.

    Instances with the same anchors wait in one queue, so a prediction is held against each set of anchors once, however many wait.
    """

    def __init__(self) -> None:
        self.anchored: dict[tuple[str, ...], deque[tuple[int, int, int | None]]] = {}
        self.plain: deque[tuple[int, int | None]] = deque()
        self.seen = 0

    def expect(self, ident: int, page: int | None, anchors: list[str]) -> None:
        self.seen += 1
        if anchors:
            self.anchored.setdefault(tuple(sorted(set(anchors))), deque()).append((self.seen, ident, page))
        else:
            self.plain.append((ident, page))

    def meet(self, text: str) -> tuple[str, int | None, int | None]:
        """What a prediction is, and the instance and page that it goes to."""
        fits = [(queue[0][0], anchors) for anchors, queue in self.anchored.items() if all(a in text for a in anchors)]
        if fits:
            anchors = min(fits)[1]
            _, ident, page = self.anchored[anchors].popleft()
            if not self.anchored[anchors]:
                del self.anchored[anchors]
            return "tp_identified", ident, page
        return ("tp_unverified", *self.plain.popleft()) if self.plain else ("fp", None, None)

    def missed(self) -> list[int]:
        return [x[1] for x in sorted(x for queue in self.anchored.values() for x in queue)] + [x[0] for x in self.plain]


def identity_pairs(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """PAIRS: a row for each pair (tp_identified, tp_unverified) and for each instance left over (fp, fn).

    expected: sample_id, checker, severity, instance_id, page, anchors; predicted: these without anchors, and evidence, message,
    suggestion, block_id, rule_id. Rows are sorted in a shuffle, expected ones first; a task holds one group's expected instances
    and passes its predictions. Null group values count as empty; empty anchors don't count.
    """
    keys = ["sample_id", "checker", "severity"]
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in keys]
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("evidence", "message", "suggestion", "block_id")])
    ends = [F.col("instance_id").cast("long").alias("instance_id"), F.col("page").cast("int").alias("page")]
    anchors = F.filter(F.coalesce("anchors", F.array().cast("array<string>")), lambda a: a.isNotNull() & (a != ""))
    e = expected.select(*named, F.lit(False).alias("predicted"), *_places(expected), *ends, anchors.alias("anchors"), F.lit("").alias("text"))
    p = predicted.select(*named, F.lit(True).alias("predicted"), *_places(predicted), *ends, F.array().cast("array<string>").alias("anchors"), text.alias("text"))
    order = [*keys, "predicted", *[f"place_{c}" for c in ORDER], "instance_id"]

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, waiting = None, Waiting()
        far = lambda a, b: a is not None and b is not None and abs(a - b) > 1
        frame = lambda rows: pd.DataFrame(rows, columns=[f.split()[0] for f in PAIRS.split(", ")]).astype({"expected_id": "Int64", "predicted_id": "Int64"})
        for pdf in batches:
            out = []
            pages = [None if pd.isna(x) else int(x) for x in pdf["page"]]
            for sample, checker, severity, is_predicted, ident, page, wanted, words in zip(*(pdf[c] for c in [*keys, "predicted", "instance_id"]), pages, pdf["anchors"], pdf["text"], strict=True):
                if (key := (sample, checker, severity)) != last:
                    if last is not None:
                        out += [(*last, "fn", x, None, False) for x in waiting.missed()]
                    last, waiting = key, Waiting()
                if is_predicted:
                    outcome, mine, its_page = waiting.meet(words)
                    out.append((*key, outcome, mine, ident, mine is not None and far(its_page, page)))
                else:
                    waiting.expect(ident, page, list(wanted))
            yield frame(out)
        if last is not None:
            yield frame([(*last, "fn", x, None, False) for x in waiting.missed()])

    return e.unionByName(p).repartition(*keys).sortWithinPartitions(*order).mapInPandas(matched, PAIRS)


def identity_match(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """The outcomes of identity_pairs, counted by sample, checker and severity. Instances need no instance_id."""
    numbered = lambda df: df if "instance_id" in df.columns else df.withColumn("instance_id", F.monotonically_increasing_id())
    pairs = identity_pairs(numbered(expected), numbered(predicted))
    n = lambda test, name: F.sum(test.cast("long")).alias(name)
    outcomes = [n(F.col("outcome") == x, x) for x in ("tp_identified", "tp_unverified", "fp", "fn")]
    return pairs.groupBy("sample_id", "checker", "severity").agg(*outcomes, n(F.col("page_shifted"), "page_mismatches"))


def evaluation_report(pairs: DataFrame) -> DataFrame:
    """scope, sample_id, checker, severity, tp_identified, tp_unverified, fp, fn, page_mismatches, precision_ppm, recall_ppm, f1_ppm,
    json, markdown of the rows of identity_pairs: over all, by checker, by severity, by both, and by sample, in one pass.

    Rates are millionths, cut; null where a denominator is 0. The JSON has the counts and rates of a row, the Markdown is a row of a
    table. An empty table gives no rows.
    """
    kinds = ("tp_identified", "tp_unverified", "fp", "fn")
    n = lambda test, name: F.coalesce(F.sum(test.cast("long")), F.lit(0)).alias(name)
    sets = [[], ["checker"], ["severity"], ["checker", "severity"], ["sample_id"]]
    keys = ["sample_id", "checker", "severity"]
    missing = [F.grouping(k).alias(f"no_{k}") for k in keys]
    counts = pairs.groupingSets([[F.col(k) for k in x] for x in sets], *keys).agg(*[n(F.col("outcome") == x, x) for x in kinds], n(F.col("page_shifted"), "page_mismatches"), *missing)
    named = [F.when(sum((F.col(f"no_{k}") for k in keys if k not in x), F.lit(0)) + sum((1 - F.col(f"no_{k}") for k in x), F.lit(0)) == 3, "+".join(x) or "all") for x in sets]
    tp = F.col("tp_identified") + F.col("tp_unverified")
    ppm = lambda a, b: F.when(b > 0, F.call_function("div", a * 1_000_000, b))
    rows = counts.select(F.coalesce(*named).alias("scope"), *keys, *kinds, "page_mismatches", ppm(tp, tp + F.col("fp")).alias("precision_ppm"), ppm(tp, tp + F.col("fn")).alias("recall_ppm"), ppm(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1_ppm"))
    shown = ["scope", *keys, *kinds, "page_mismatches", "precision_ppm", "recall_ppm", "f1_ppm"]
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-"))
    return rows.withColumn("json", F.to_json(F.struct(*shown))).withColumn("markdown", F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, shown)), F.lit(" |")))
