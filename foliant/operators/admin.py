"""Operators over the tables of rule-set versions, purged documents, interrupted tasks and sessions.

Each is a projection, a filter, or joins on keys followed by partial aggregation; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.columns import strip

#: The states of a version that an action starts from, and that it leads to.
FROM = {"submit": "draft", "approve": "submitted", "reject": "submitted", "publish": "approved"}
TO = {"submit": "submitted", "approve": "approved", "reject": "rejected", "publish": "published"}
MOST_PERCENT = 90
#: States of versions that are still worked on.
WORKING = ("draft", "rejected", "submitted", "approved")


def _tested(versions: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """versions with `tested`: whether a test of the same key and content is done."""
    done = tests.where(F.col("status") == "done").select(key, "content_sha256").distinct().withColumn("tested", F.lit(True))
    return versions.join(done, [key, "content_sha256"], "left").withColumn("tested", F.coalesce("tested", F.lit(False)))


def judged(versions: DataFrame, tests: DataFrame, action: str, actor: str = "actor", note: str = "note") -> DataFrame:
    """versions with `refused`, the first reason against an action, and `next_state`.

    versions: version_id, ruleset_id, state, assigned_reviewer, submitted_by, created_by, content_sha256, enabled_rules, and the
    columns of the actor and the note. tests: version_id, ruleset_id, content_sha256, status. Four eyes: who made or submitted
    a version neither reviews nor publishes it. To be submitted a version needs a test of its own; to be published, one of
    the same content in its rule set.
    """
    c, who = F.col, F.col(actor)
    empty = lambda x: F.coalesce(x, F.lit("")) == ""
    if action in ("submit", "publish"):
        versions = _tested(versions, tests, "version_id" if action == "submit" else "ruleset_id")
    state = [(~c("state").eqNullSafe(FROM[action]), f"not_{FROM[action]}")]
    reviewer = [(~who.eqNullSafe(c("assigned_reviewer")), "not_reviewer"), (who.eqNullSafe(c("submitted_by")) | who.eqNullSafe(c("created_by")), "own_version")]
    untested = lambda: (~c("tested"), "untested")
    checks = {
        "submit": lambda: [(empty(c("assigned_reviewer")), "no_reviewer"), (c("assigned_reviewer").eqNullSafe(who), "own_review"), untested()],
        "approve": lambda: reviewer,
        "reject": lambda: [*reviewer, (empty(strip(F.coalesce(note, F.lit("")))), "no_note")],
        "publish": lambda: [*reviewer, (F.coalesce("enabled_rules", F.lit(0)) < 1, "no_enabled_rule"), untested()],
    }[action]()
    refused = F.coalesce(*[F.when(bad, reason) for bad, reason in state + checks])
    return versions.withColumn("refused", refused).withColumn("next_state", F.when(c("refused").isNull(), TO[action]).otherwise(c("state"))).drop("tested")


def published(versions: DataFrame, chosen: DataFrame) -> DataFrame:
    """versions after those of `chosen` (version_id, ruleset_id; one of a rule set) are published: the one before is retired."""
    new = chosen.select("ruleset_id", F.col("version_id").alias("new_id"))
    state = F.when(F.col("version_id") == F.col("new_id"), "published").when(F.col("new_id").isNotNull() & (F.col("state") == "published"), "retired").otherwise(F.col("state"))
    return versions.join(new, "ruleset_id", "left").withColumn("state", state).select(*versions.columns)


def cloned(versions: DataFrame, chosen: Column, content: list[str], by: Column) -> DataFrame:
    """Drafts with the content of chosen versions, numbered on from the rule set's last version: a clone, or an older one restored.

    One row for each rule set: a draft, or with `refused` the reason against one (and no number, state, or content): a version that
    is still worked on, or none that is chosen.
    """
    source = F.max_by(F.when(chosen, F.struct("number", *content)), F.when(chosen, F.col("number")))
    of = versions.groupBy("ruleset_id").agg(F.max("number").alias("last"), F.coalesce(F.bool_or(F.col("state").isin(*WORKING)), F.lit(False)).alias("open"), source.alias("of"))
    refused = F.when(F.col("open"), "open_version").when(F.col("of").isNull(), "no_source")
    made = lambda c: F.when(refused.isNull(), c)
    return of.select("ruleset_id", made(F.col("last") + 1).alias("number"), made(F.lit("draft")).alias("state"), made(by).alias("created_by"), made(F.col("of.number")).alias("cloned_from"), *[made(F.col(f"of.{x}")).alias(x) for x in content], refused.alias("refused"))


def purge_totals(documents: DataFrame, reviews: DataFrame, items: DataFrame, document: str, review: str) -> DataFrame:
    """kind, n: what goes with some documents: they themselves, their reviews, and batch items of either.

    An item that has both a purged document and a purged review counts once.
    """
    gone = documents.select(document).where(F.col(document).isNotNull()).distinct()
    lost = reviews.join(gone, document, "left_semi").select(review)
    flagged = items.join(gone.withColumn("by_document", F.lit(1)), document, "left").join(lost.distinct().withColumn("by_review", F.lit(1)), review, "left")
    n = lambda kind, rows: rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("documents", documents.where(F.col(document).isNotNull())).unionByName(n("reviews", lost)).unionByName(n("batch_items", flagged.where("by_document = 1 or by_review = 1")))


def recovered(tasks: DataFrame, active: Column, cancelled: Column, at: Column) -> DataFrame:
    """tasks (status, stage, progress, completed_at) as a restart leaves them: active ones that were to be cancelled end so,
    other active ones are queued again, with their progress bounded."""
    ends, again = active & F.coalesce(cancelled, F.lit(False)), active & ~F.coalesce(cancelled, F.lit(False))
    by = lambda end, queued, c: F.when(ends, end).when(again, queued).otherwise(F.col(c)).alias(c)
    new = {
        "status": by(F.lit("cancelled"), F.lit("queued"), "status"),
        "stage": by(F.lit("cancelled"), F.lit("recovered"), "stage"),
        "progress": by(F.lit(100), F.least(F.coalesce("progress", F.lit(0)), F.lit(MOST_PERCENT)), "progress"),
        "completed_at": by(at, F.col("completed_at"), "completed_at"),
    }
    return tasks.select(*[new.get(c, F.col(f"`{c}`")) for c in tasks.columns])


def active_sessions(sessions: DataFrame, user: Column, at: Column) -> DataFrame:
    """Sessions of their own user that are neither revoked nor past their end at a time; without an end they stay."""
    return sessions.where((F.col("user_id") == user) & F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > at)))
