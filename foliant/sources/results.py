"""What a review hands on, as tables: result documents, report parts, highlights for pages, batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import texts
from foliant.plans import review
from foliant.plans.rules import RuleSet

#: Highlight colours (red, green, blue) by severity, and the width at which summary lines are cut.
COLOURS = {"error": (1.0, 0.0, 0.0), "warning": (1.0, 0.85, 0.0), "info": (0.2, 0.55, 1.0)}
WIDTH = 42
#: The columns of a batch summary.
BATCH_COLUMNS = ("文件名", "结论", "error数", "warning数", "info数", "审查时间")


def result_json(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """doc_id, result: summary and ordered findings of each document as JSON. Findings are grouped by document once."""
    found = review.findings(documents, rules)
    items = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("rule_ord", "seq", *found.columns[3:])]))).alias("findings"))
    whole = review.summary(documents, rules).join(items, "doc_id", "left")
    body = F.struct(F.struct(*[c for c in whole.columns if c not in ("doc_id", "findings")]).alias("summary"), F.coalesce("findings", F.array()).alias("findings"))
    return whole.select("doc_id", F.to_json(body).alias("result"))


def source_of(confidence: Column, layer: Column) -> Column:
    """AI for what a model found, else rule."""
    return F.when((confidence == "ai") | (layer == "llm"), "AI").otherwise("rule")


def report(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts by severity, counts by checker, detail rows) of each document."""
    by = lambda c: findings.groupBy("doc_id", F.coalesce(c, F.lit("unknown")).alias(c)).agg(F.count("*").alias("findings"))
    detail = findings.select("doc_id", "rule_ord", "seq", "rule_id", "checker", "severity", "page", "message", "suggestion", "evidence", source_of(F.col("confidence"), F.col("layer")).alias("source"))
    return by("severity"), by("checker"), detail


def annotations(findings: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, rect, colour, content: highlights of the findings with a box, cut to their pages; empty ones are left out.

    pages: doc_id, page, width, height.
    """
    b = F.col("bbox")
    clipped = F.struct(F.greatest(b["x0"], F.lit(0.0)).alias("x0"), F.greatest(b["y0"], F.lit(0.0)).alias("y0"), F.least(b["x1"], "width").alias("x1"), F.least(b["y1"], "height").alias("y1"))
    colour = lambda s: F.array(*[F.lit(x) for x in COLOURS[s]])
    coloured = F.when(F.col("severity") == "error", colour("error")).when(F.col("severity") == "warning", colour("warning")).otherwise(colour("info"))
    content = texts("[", F.col("rule_id"), "] ", F.col("message"), "｜建议：", F.col("suggestion"))
    placed = findings.where("bbox is not null and page is not null").join(pages, ["doc_id", "page"])
    return placed.select("doc_id", "page", clipped.alias("rect"), coloured.alias("colour"), content.alias("content")).where("rect.x1 > rect.x0 and rect.y1 > rect.y0")


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """The text in parts of `width` characters, line breaks as blanks; an empty text is one empty part."""
    flat = F.regexp_replace(text, "[\r\n]", " ")
    starts = F.sequence(F.lit(1), F.greatest(F.length(flat), F.lit(1)), F.lit(width))
    return F.transform(starts, lambda at: F.substring(flat, at, F.lit(width)))


def summary_lines(findings: DataFrame) -> DataFrame:
    """doc_id, line, text: the summary of the findings without a box, numbered in order and wrapped."""
    loose = findings.where("bbox is null or page is null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "seq", "rule_id", "message"))).alias("all"))
    lines = F.flatten(F.transform("all", lambda x, i: wrapped(texts((i + 1).cast("string"), ". [", x["rule_id"], "] ", x["message"]))))
    return loose.select("doc_id", F.posexplode(lines).alias("line", "text"))


def batch_summary(summaries: DataFrame, batches: DataFrame, reviewed_at: str = "review_time") -> DataFrame:
    """Rows of complete batches: batch_id and BATCH_COLUMNS.

    batches: batch_id, doc_id, filename, status, review_time. A batch with an open item gives none.
    """
    open_ = batches.where(~F.col("status").isin("done", "failed", "cancelled", "timed_out")).select("batch_id").distinct()
    rows = batches.join(open_, "batch_id", "left_anti").join(summaries, "doc_id", "left")
    return rows.select("batch_id", *[F.col(c).alias(n) for c, n in zip(("filename", "conclusion", "errors", "warnings", "infos", reviewed_at), BATCH_COLUMNS, strict=True)])
