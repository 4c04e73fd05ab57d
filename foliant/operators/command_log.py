"""Rule sets from a log of commands: what each command did, and the versions, the audit and the statuses that follow.

A command is judged against what the ones before it have left of its rule set, under optimistic concurrency: who saves names the
revision that they have seen. So the log is folded in order, with one rule set's versions held; rule sets are independent, rows
are sorted in a shuffle and pass by. Refusals and conflicts are rows like any other, and change nothing.

| command | takes | refused as |
|---|---|---|
| seed | content, enabled_rules | exists |
| clone | source (a version's number; null: the published one) | open_version, no_source |
| save | version, revision, content, enabled_rules | no_version, not_editable, conflict, invalid (a null or empty content) |
| test | version (its content is tested) | no_version |
| submit | version, reviewer | no_version, not_draft, no_reviewer, own_review, untested |
| approve, reject | version; reject a note | no_version, not_submitted, not_reviewer, own_version, no_note |
| publish | version | no_version, not_approved, not_reviewer, own_version, no_enabled_rule, untested |
| disable, enable | | unknown, never_published (enable) |
| delete | | unknown, published, not_editable |

Any other command is refused as unknown_command, and all but seed and clone on a rule set without versions as unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States that can be changed, and those that are still worked on.
EDITABLE, WORKING = ("draft", "rejected"), ("draft", "rejected", "submitted", "approved")
COMMAND = "ruleset_id string, seq long, command string, actor string, version long, revision long, source long, content string, enabled_rules long, reviewer string, note string"
OUTCOME = "ruleset_id string, seq long, command string, actor string, refused string, version long, state string, revision long, content string, retired long, active long, status string"


@dataclass
class Version:
    state: str
    content: str
    enabled: int
    created_by: str
    revision: int = 1
    submitted_by: str = ""
    reviewer: str = ""
    tested: set[str] = field(default_factory=set)


@dataclass
class RuleSetState:
    """One rule set's versions by number, its published one, its status, and the contents that any of its tests has passed."""

    versions: dict[int, Version] = field(default_factory=dict)
    active: int | None = None
    status: str = ""
    tested: set[str] = field(default_factory=set)
    last: int = 0

    def apply(self, c: dict) -> tuple[str | None, int | None, int | None]:
        """(reason of a refusal, the version that it is about, the version that it retires)."""
        act = getattr(self, f"_{c['command']}", None) if c["command"] in ("seed", "clone", "save", "test", "submit", "approve", "reject", "publish", "disable", "enable", "delete") else None
        if act is None:
            return "unknown_command", None, None
        if not self.versions and c["command"] not in ("seed", "clone"):
            return "unknown", None, None
        if c["command"] in ("save", "test", "submit", "approve", "reject", "publish"):
            version = self.versions.get(c["version"])
            if version is None:
                return "no_version", None, None
            before = self.active
            refused = act(version, c)
            retired = before if not refused and c["command"] == "publish" and before != c["version"] else None
            return refused, c["version"], retired
        return (*act(c), None)

    def _new(self, version: Version) -> int:
        self.last += 1
        self.versions[self.last] = version
        return self.last

    def _seed(self, c: dict) -> tuple[str | None, int | None]:
        if self.versions:
            return "exists", None
        self.active, self.status = self._new(Version("published", c["content"] or "", c["enabled_rules"] or 0, c["actor"] or "")), "active"
        return None, self.active

    def _clone(self, c: dict) -> tuple[str | None, int | None]:
        if any(v.state in WORKING for v in self.versions.values()):
            return "open_version", None
        source = self.versions.get(self.active if c["source"] is None else c["source"])
        if source is None:
            return "no_source", None
        return None, self._new(Version("draft", source.content, source.enabled, c["actor"] or ""))

    def _save(self, v: Version, c: dict) -> str | None:
        if v.state not in EDITABLE:
            return "not_editable"
        if v.revision != c["revision"]:
            return "conflict"
        if not c["content"]:
            return "invalid"
        v.content, v.enabled, v.revision, v.state = c["content"], c["enabled_rules"] or 0, v.revision + 1, "draft"
        return None

    def _test(self, v: Version, c: dict) -> None:
        v.tested.add(v.content)
        self.tested.add(v.content)

    def _submit(self, v: Version, c: dict) -> str | None:
        if v.state != "draft":
            return "not_draft"
        if not c["reviewer"]:
            return "no_reviewer"
        if c["reviewer"] == c["actor"]:
            return "own_review"
        if v.content not in v.tested:
            return "untested"
        v.state, v.reviewer, v.submitted_by = "submitted", c["reviewer"], c["actor"] or ""
        return None

    def _judged(self, v: Version, c: dict, state: str) -> str | None:
        if v.state != state:
            return f"not_{state}"
        if (c["actor"] or "") != v.reviewer:
            return "not_reviewer"
        return "own_version" if v.reviewer in (v.submitted_by, v.created_by) else None

    def _approve(self, v: Version, c: dict) -> str | None:
        if refused := self._judged(v, c, "submitted"):
            return refused
        v.state = "approved"
        return None

    def _reject(self, v: Version, c: dict) -> str | None:
        if refused := self._judged(v, c, "submitted") or (None if (c["note"] or "").strip() else "no_note"):
            return refused
        v.state = "rejected"
        return None

    def _publish(self, v: Version, c: dict) -> str | None:
        if refused := self._judged(v, c, "approved"):
            return refused
        if v.enabled < 1:
            return "no_enabled_rule"
        if v.content not in self.tested:
            return "untested"
        if self.active is not None:
            self.versions[self.active].state = "retired"
        v.state, self.active, self.status = "published", c["version"], "active"
        return None

    def _disable(self, c: dict) -> tuple[str | None, int | None]:
        self.status = "disabled"
        return None, self.active

    def _enable(self, c: dict) -> tuple[str | None, int | None]:
        if self.active is None:
            return "never_published", None
        self.status = "active"
        return None, self.active

    def _delete(self, c: dict) -> tuple[str | None, int | None]:
        if self.active is not None:
            return "published", None
        if any(v.state not in EDITABLE for v in self.versions.values()):
            return "not_editable", None
        self.__init__()
        return None, None


def outcomes(commands: DataFrame) -> DataFrame:
    """OUTCOME of each command of COMMAND (columns that a log lacks are null): `refused` with its reason or null; the version that it
    is about as it stands then; the version that it retires; the rule set's published version and status. In order of seq; commands of
    a null rule set are left out."""
    fields = dict(x.split() for x in COMMAND.split(", "))
    rows = commands.select(*[(F.col(c) if c in commands.columns else F.lit(None)).cast(kind).alias(c) for c, kind in fields.items()]).where("ruleset_id is not null")
    numbers = [c for c, kind in fields.items() if kind == "long"]
    names = [x.split()[0] for x in OUTCOME.split(", ")]

    def folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, RuleSetState()
        for pdf in batches:
            out = []
            for c in pdf.to_dict("records"):
                c |= {k: None if pd.isna(c[k]) else int(c[k]) for k in numbers} | {k: None if pd.isna(c[k]) else c[k] for k in ("command", "actor", "content", "reviewer", "note")}
                if c["ruleset_id"] != last:
                    last, state = c["ruleset_id"], RuleSetState()
                refused, number, retired = state.apply(c)
                v = state.versions.get(number)
                out.append((last, c["seq"], c["command"], c["actor"], refused, number, v and v.state, v and v.revision, v and v.content, retired, state.active, state.status or None))
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(("version", "revision", "retired", "active"), "Int64"))

    order = ["ruleset_id", "seq", "command", "actor", "version", "revision", "content"]
    return rows.repartition("ruleset_id").sortWithinPartitions(*order).mapInPandas(folded, OUTCOME)


def audit(done: DataFrame) -> DataFrame:
    """ruleset_id, seq, command, actor, version of what was done."""
    return done.where("refused is null").select("ruleset_id", "seq", "command", "actor", "version")


def versions(done: DataFrame) -> DataFrame:
    """ruleset_id, version, state, revision, content of each version as the log leaves it; those of deleted rule sets are gone."""
    did = done.where("refused is null")
    gone = did.where("command = 'delete'").groupBy("ruleset_id").agg(F.max("seq").alias("gone"))
    own = did.where("version is not null").select("ruleset_id", "seq", "version", "state", "revision", "content")
    retired = did.where("retired is not null").select("ruleset_id", "seq", F.col("retired").alias("version"), F.lit("retired").alias("state"), F.lit(None).cast("long").alias("revision"), F.lit(None).cast("string").alias("content"))
    rows = own.unionByName(retired).join(gone, "ruleset_id", "left").where("gone is null or seq > gone")
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return rows.groupBy("ruleset_id", "version").agg(latest("state"), latest("revision"), latest("content"))


def statuses(done: DataFrame) -> DataFrame:
    """ruleset_id, active, status of each rule set that is left."""
    last = done.groupBy("ruleset_id").agg(F.max_by(F.struct("active", "status"), "seq").alias("x"), F.max_by(F.struct(F.col("command").alias("c"), F.col("refused").alias("r")), F.when(F.col("refused").isNull(), F.col("seq"))).alias("d"))
    return last.where("d is not null and d.c <> 'delete'").select("ruleset_id", "x.active", "x.status")
