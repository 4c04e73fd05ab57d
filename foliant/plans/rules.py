"""Rule sets: loading, validation, and the registry of operators."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, SparkSession

Operator = Callable[["Rule"], Column]
OPERATORS: dict[str, Operator] = {}
#: Rules that need a model. They stay off unless a provider is given, and are then reported as skipped.
NEEDS_MODEL = ("anonymity_check", "title_content_match", "cross_consistency_semantic")
SEVERITIES = ("error", "warning", "info")


class RuleError(ValueError):
    """A rule set or a rule's parameters can't be used."""


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str = "error"
    description: str = ""
    params: dict = field(default_factory=dict)
    enabled: bool = True


@dataclass(frozen=True)
class RuleSet:
    id: str
    name: str
    rules: tuple[Rule, ...]
    description: str = ""


def operator(name: str) -> Callable[[Operator], Operator]:
    """Registers a function Rule -> array<finding> over a document row."""

    def put(f: Operator) -> Operator:
        OPERATORS[name] = f
        return f

    return put


def registered() -> dict[str, Operator]:
    """All operators; the module that holds them is imported on first use, as it needs this one."""
    import foliant.operators.checks  # noqa: F401

    return OPERATORS


def read(text: str) -> RuleSet:
    """A rule set from YAML as it stands, so that catalog.faults can tell its faults with their places."""
    data = yaml.safe_load(text) or {}
    if not isinstance(data, dict):
        raise RuleError("a rule set is a mapping")
    head = data.get("ruleset") if isinstance(data.get("ruleset"), dict) else data
    known = {"id", "type", "severity", "description", "params", "enabled"}
    rules = tuple(Rule(**{k: v for k, v in r.items() if k in known and v is not None}) for r in data.get("rules") or [])
    return RuleSet(str(head.get("id", "")), str(head.get("name", "")), rules, str(head.get("description", "")))


def load(text: str) -> RuleSet:
    """A rule set from YAML; raises RuleError with every fault that it has."""
    found = read(text)
    if faults := validate(found):
        raise RuleError("; ".join(faults))
    return found


def validate(rules: RuleSet) -> list[str]:
    faults = [] if re.fullmatch(r"[A-Za-z0-9_-]{1,64}", rules.id) else [f"bad rule set id {rules.id!r}"]
    seen: set[str] = set()
    known = registered()
    for r in rules.rules:
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_-]{1,31}", r.id):
            faults.append(f"bad rule id {r.id!r}")
        if r.id in seen:
            faults.append(f"rule id {r.id} comes twice")
        seen.add(r.id)
        if r.severity not in SEVERITIES:
            faults.append(f"{r.id}: bad severity {r.severity!r}")
        if r.type not in known and r.type not in NEEDS_MODEL:
            faults.append(f"{r.id}: unknown type {r.type!r}; known: {', '.join(sorted({*known, *NEEDS_MODEL}))}")
    return faults


def scan(spark: SparkSession, folder: str) -> dict[str, RuleSet]:
    """The rule sets of a folder's YAML files by id, wherever Spark reads it; raises RuleError if two have one id. Rule sets are
    configuration of a few kilobytes, which plans are built from, so their texts come to the driver."""
    texts = spark.read.option("pathGlobFilter", "*.y*ml").text(folder, wholetext=True).collect()
    found: dict[str, RuleSet] = {}
    for rules in (load(r.value) for r in texts):
        if rules.id in found:
            raise RuleError(f"two rule sets are called {rules.id}")
        found[rules.id] = rules
    return found
