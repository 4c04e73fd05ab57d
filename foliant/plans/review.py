"""Reviews: a rule set over many documents, in one projection, and what is concluded from the findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import foliant.operators.checks  # noqa: F401  registers the operators
from foliant.functions.columns import EMPTY

from .rules import NEEDS_MODEL, OPERATORS, Rule, RuleSet

#: Statuses of a page whose content may be missing from what was read.
UNCERTAIN = ("mixed_image_unread",)


def _of_rule(rule: Rule, number: int) -> tuple[Column, str]:
    """The rule's findings, numbered, and its status. A rule that can't be built fails alone, as a system error."""
    try:
        found, status = OPERATORS[rule.type](rule), "executed"
    except Exception as e:  # noqa: BLE001  one rule's fault is its own
        found = F.array(F.struct(F.lit("error"), F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(""), F.lit(f"规则 {rule.id} 执行失败：{e}"), F.lit(""), F.lit("system"), F.lit("system"))).cast(EMPTY)
        status = "failed"
    numbered = F.transform(found, lambda x, i: F.struct(F.lit(number).alias("rule_ord"), i.alias("seq"), F.lit(rule.id).alias("rule_id"), F.lit(rule.type).alias("checker"), x.alias("f")))
    return numbered, status


def page_findings(number: int) -> Column:
    """A manual finding for each page that may not have been read in full, and for each warning of the parser."""
    kind = lambda i, page, message: F.struct(F.lit(number).alias("rule_ord"), i.alias("seq"), F.lit("page_quality").alias("rule_id"), F.lit("page_quality").alias("checker"), F.struct(F.lit("info").alias("severity"), page.cast("int").alias("page"), F.lit(None).cast("string").alias("block_id"), F.lit("").alias("evidence"), message.alias("message"), F.lit("请人工核对").alias("suggestion"), F.lit("manual_required").alias("confidence"), F.lit("rule").alias("layer")).alias("f"))
    pages = F.filter("page_meta", lambda m: m["status"].isin(*UNCERTAIN))
    of_pages = F.transform(pages, lambda m, i: kind(i, m["page_number"], F.concat(F.lit("第 "), m["page_number"].cast("string"), F.lit(" 页可能未完整读取"))))
    of_warnings = F.transform("parse_warnings", lambda w, i: kind(i + 10_000, F.lit(None), w))
    return F.concat(of_pages, of_warnings)


def _parts(rules: RuleSet) -> tuple[Column, Column]:
    """What a rule set makes of a document: found (array of numbered findings) and statuses (array)."""
    on = [(i, r) for i, r in enumerate(rules.rules) if r.enabled]
    lists, statuses = [], []
    for i, r in on:
        if r.type in NEEDS_MODEL:
            statuses.append((r, "skipped"))
            continue
        found, status = _of_rule(r, i)
        lists.append(found)
        statuses.append((r, status))
    given = F.array(*[F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.type).alias("type"), F.lit(r.type in NEEDS_MODEL).alias("requires_ai"), F.lit(s).alias("status")) for r, s in statuses]) if statuses else F.array().cast("array<struct<rule_id:string,type:string,requires_ai:boolean,status:string>>")
    return F.concat(*lists, page_findings(len(rules.rules))), given


def reviewed(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """Documents (doc_id, ...) with found (array of numbered findings) and statuses (array). Nothing is shuffled."""
    found, statuses = _parts(rules)
    return documents.select("doc_id", "filename", "blocks", found.alias("found"), statuses.alias("statuses"))


def reviewed_by(documents: DataFrame, sets: dict[str, RuleSet], on: str) -> DataFrame:
    """`reviewed`, with each document under the rule set that its column `on` names, in one scan and one projection. A document
    whose rule set is unknown (or null) has a system finding and a failed status in place of a review."""
    name = F.coalesce(F.col(on), F.lit(""))
    lost = Rule("ruleset", "ruleset")
    message = F.concat(F.lit("规则集 "), name, F.lit(" 不存在"))
    system = F.array(F.struct(F.lit("error").alias("severity"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("block_id"), F.lit("").alias("evidence"), message.alias("message"), F.lit("").alias("suggestion"), F.lit("system").alias("confidence"), F.lit("system").alias("layer"))).cast(EMPTY)
    found = F.concat(F.transform(system, lambda x, i: F.struct(F.lit(0).alias("rule_ord"), i.alias("seq"), F.lit(lost.id).alias("rule_id"), F.lit(lost.type).alias("checker"), x.alias("f"))), page_findings(1))
    failed = F.array(F.struct(F.lit(lost.id).alias("rule_id"), F.lit(lost.type).alias("type"), F.lit(False).alias("requires_ai"), F.lit("failed").alias("status")))
    parts = {key: _parts(rules) for key, rules in sets.items()}
    pick = lambda i, other: F.coalesce(*[F.when(name == key, x[i]) for key, x in parts.items()], other)
    return documents.select("doc_id", "filename", "blocks", F.col(on), pick(0, found).alias("found"), pick(1, failed).alias("statuses"))


def once(rows: DataFrame, column: str) -> DataFrame:
    """Rows with a column that what follows reads as often as it likes and that is made once. An explode of a column makes Spark
    filter on its size first; without this, that filter, and each field read of it, would make the column again."""
    kept = F.explode(F.array(F.struct(column)))
    return rows.select(*[c for c in rows.columns if c != column], kept.alias("once_")).select(*[c for c in rows.columns if c != column], F.col(f"once_.{column}").alias(column))


def findings(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """One row for each finding, in order (rule_ord, seq); page and box are filled in from the finding's block."""
    rows = once(reviewed(documents, rules), "found").select("doc_id", "blocks", F.explode("found").alias("x"))
    b = F.get(F.filter("blocks", lambda b: b["id"] == F.col("x.f.block_id")), F.lit(0))
    return rows.select("doc_id", "x.rule_ord", "x.seq", "x.rule_id", "x.checker", "x.f.severity", F.coalesce("x.f.page", b["page"]).alias("page"), "x.f.block_id", b["bbox"].alias("bbox"), "x.f.evidence", "x.f.message", "x.f.suggestion", "x.f.confidence", "x.f.layer")


def rule_status(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """doc_id, rule_id, type, requires_ai, status: failed and skipped rules, degraded ones (they left a manual finding), executed."""
    rows = reviewed(documents, rules).select("doc_id", "found", F.explode("statuses").alias("s"))
    manual = F.exists("found", lambda x: (x["rule_id"] == F.col("s.rule_id")) & (x["f"]["confidence"] == "degraded"))
    return rows.select("doc_id", "s.rule_id", "s.type", "s.requires_ai", F.when((F.col("s.status") == "executed") & manual, "degraded").otherwise(F.col("s.status")).alias("status"))


def summary(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """One row for each document: counts by severity, what wasn't settled, and the conclusion. A document whose review is
    incomplete never passes."""
    r = reviewed(documents, rules)
    count = lambda f: F.size(F.filter("found", f)).cast("long")
    status = lambda *s: F.size(F.filter("statuses", lambda x: x["status"].isin(*s))).cast("long")
    out = r.select(
        "doc_id",
        F.size("found").cast("long").alias("total_issues"),
        count(lambda x: x["f"]["severity"] == "error").alias("errors"),
        count(lambda x: x["f"]["severity"] == "warning").alias("warnings"),
        count(lambda x: x["f"]["severity"] == "info").alias("infos"),
        count(lambda x: x["f"]["confidence"] == "manual_required").alias("manual_required_checks"),
        status("skipped").alias("skipped_checks"),
        status("failed").alias("failed_checks"),
        F.size("statuses").cast("long").alias("rules"),
        (F.size(F.filter("statuses", lambda x: x["requires_ai"] & (x["status"] != "executed"))) == 0).alias("ai_complete"),
    )
    incomplete = (F.col("rules") == 0) | (F.col("failed_checks") > 0) | (F.col("skipped_checks") > 0) | (F.col("manual_required_checks") > 0)
    return out.withColumn("review_complete", ~incomplete).withColumn("conclusion", F.when(incomplete, "incomplete").when(F.col("errors") > 0, "needs_revision").otherwise("pass")).drop("rules")


def checker_counts(documents: DataFrame, rules: RuleSet) -> DataFrame:
    """Findings of each checker, over all documents."""
    return once(reviewed(documents, rules).select("found"), "found").select(F.explode("found").alias("x")).groupBy(F.coalesce("x.checker", F.lit("unknown")).alias("checker"), F.col("x.f.severity").alias("severity")).agg(F.count("*").alias("findings"))
