"""Operators over the operational tables: consents, task progress, readable text, rule-set versions and their tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.columns import strip, sum_of

#: The least characters of a text that counts as read, and the bounds of a running task's progress.
LEAST_CHARS, FROM_PERCENT, SPAN_PERCENT, MOST_PERCENT = 80, 30, 60, 90


def consented(rows: DataFrame, consents: DataFrame, key: str, granted: Column) -> DataFrame:
    """Rows whose key has a consent that is granted: a semi join, so several consents give no copies."""
    return rows.join(consents.where(granted).select(key), key, "left_semi")


def progress(rows: DataFrame, key: str, order: list[str], weight: Column) -> DataFrame:
    """key, ord, progress after each step of a task: the share of the weights done, in percent of a bounded span."""
    w = Window.partitionBy(key)
    numbered = rows.select(key, F.row_number().over(w.orderBy(*order)).cast("long").alias("ord"), weight.cast("long").alias("weight"))
    done, whole = F.sum("weight").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), F.sum("weight").over(w)
    percent = F.least(F.lit(MOST_PERCENT), FROM_PERCENT + F.floor(SPAN_PERCENT * done / whole).cast("int"))
    return numbered.select(key, "ord", percent.alias("progress"))


def readable(texts: Column, least: int = LEAST_CHARS) -> tuple[Column, Column]:
    """(characters of the blocks' stripped texts, whether they are enough) of an array of texts."""
    chars = sum_of(F.transform(texts, lambda t: F.length(strip(F.coalesce(t, F.lit(""))))))
    return chars, chars >= least


def gated(rows: DataFrame, key: str, order: str, fails: Column, detail: Column) -> DataFrame:
    """Keys with failing parts: key, failing, detail (the parts' details in order). Only failing parts are shuffled."""
    parts = rows.where(fails).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), detail.alias("detail")))).alias("parts"))
    return parts.select(key, F.size("parts").cast("long").alias("failing"), F.array_join(F.transform("parts", lambda p: p["detail"]), "；").alias("detail"))


def versions(rows: DataFrame, key: str, number: str, published: Column, open_: Column) -> DataFrame:
    """key, active (the latest published version), working (the latest open one), next_version: one aggregation."""
    latest = lambda c: F.max(F.when(c, F.col(number)))
    return rows.groupBy(key).agg(latest(published).alias("active"), latest(open_).alias("working"), (F.max(number) + 1).alias("next_version"))


def latest_test(rows: DataFrame, tests: DataFrame, keys: list[str], at: str, *values: str) -> DataFrame:
    """Rows with the values of the latest test that has the same keys (version and content hash); null where there is none."""
    latest = tests.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(at)).alias("latest"))
    return rows.join(latest, keys, "left").select(*rows.columns, "latest.*")


def test_outcome(findings: DataFrame, key: str, executed: Column, with_model: bool = False, whole: bool = True) -> DataFrame:
    """Of each test: issues, errors, warnings, system failures, degraded checks, success, and whether it allows a release.

    A test succeeds if rules were executed, none failed and, with a model, none was degraded; only a whole rule set's test
    allows a release.
    """
    n = lambda c: F.count(F.when(c, 1))
    degraded = (F.col("layer") == "llm") & (F.col("severity") == "info") & F.startswith("message", F.lit("AI 检查未执行"))
    counts = findings.groupBy(key).agg(
        F.count("*").alias("issue_count"), n(F.col("severity") == "error").alias("errors"), n(F.col("severity") == "warning").alias("warnings"),
        n(F.col("layer") == "system").alias("system_failures"), n(degraded).alias("degraded_checks"), F.max(executed).alias("rules_executed"),
    )
    success = (F.col("rules_executed") > 0) & (F.col("system_failures") == 0)
    success = success & (F.col("degraded_checks") == 0) if with_model else success
    return counts.withColumn("success", success).withColumn("release_eligible", F.col("success") & F.lit(whole))


def idempotency_key(owner: Column, document_sha: Column, ruleset: str, ruleset_text: str, use_model: bool, fingerprint: str) -> Column:
    """The key by which an active task is found again: SHA-256 over owner, document, rule set, its text, model use and parser."""
    text_sha = F.sha2(F.lit(ruleset_text), 256)
    return F.sha2(F.concat_ws("|", F.coalesce(owner, F.lit("")), document_sha, F.lit(ruleset), text_sha, F.lit(str(int(use_model))), F.lit(fingerprint)), 256)
