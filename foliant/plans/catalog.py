"""The catalogue of rule types and their parameters, and the check of a rule set against it.

A rule whose parameters don't fit fails only when a review runs, as a system finding on every document. Here its faults are
found before: `faults(rules)` gives (path, message) of each, `warnings(rules)` what should be known before it runs. A rule set is
a small configuration, so both are plain functions; nothing here reads documents.
"""

from __future__ import annotations

import re
from typing import Any

from .rules import NEEDS_MODEL, RuleSet, registered

#: Parameters by rule type. A shape is a type, a list of a shape, a mapping of shapes, or a type with a bound.
NORMALIZE = ("text", "casefold", "phone", "date", "number", "list")
FORMATS = ("email", "cn_mobile", "phone", "date", "cn_id", "number", "project_code")
FIELD = {"name": "string", "aliases": ["string"], "required": "boolean", "normalize": NORMALIZE, "format": FORMATS, "pattern": "regex"}
CHUNK = {"max_chunk_chars": "integer>=1"}
PARAMETERS: dict[str, dict[str, Any]] = {
    "required_sections": {"sections": ["object"]},
    "section_order": {"expected_order": ["string"]},
    "page_limit": {"max_pages": "integer>=1", "section_limits": "object"},
    "word_limit": {"max_words": "integer>=1", "section_limits": "object"},
    "font_check": {"body_font": "string", "body_size": "number>=1"},
    "figure_table_numbering": {},
    "budget_check": {"max_ratio": "object", "total_field": "regex"},
    "date_check": {"expected_months": "integer>=1"},
    "page_number_check": {"allow_unnumbered_front_pages": "integer>=0"},
    "attachment_checklist": {"expected": ["string"]},
    "signature_page": {"keywords": ["string"]},
    "cross_field_consistency": {"fields": [FIELD], "comparisons": ["object"]},
    "required_fields": {"fields": [FIELD]},
    "field_format": {"fields": [FIELD]},
    "heading_numbering": {"skip_pages": ["integer"], "require_numbering": "boolean", "allow_mixed_styles": "boolean", "allowed_styles": "object", "max_issues": "integer>=1"},
    "layout_check": {"page": "object", "margins_mm": "object", "body": "object", "headings": "object", "max_issues": "integer>=1"},
    "anonymity_check": {"cover_pages": ["integer"], **CHUNK},
    "title_content_match": {"max_section_chars": "integer>=1", **CHUNK},
    "cross_consistency_semantic": CHUNK,
    "reference_format": {"semantic_review": "boolean", **CHUNK},
}
REQUIRED = {
    "required_sections": ["sections"], "section_order": ["expected_order"], "page_limit": ["max_pages"], "attachment_checklist": ["expected"],
    "required_fields": ["fields"], "field_format": ["fields"],
}

#: Messages.
TWICE, UNKNOWN, MISSING, TYPE, ENUM, LEAST, PATTERN = "规则 ID 重复：{}", "未知检查器：{}", "缺少必填参数", "参数类型应为 {}", "参数必须是：{}", "参数不能小于 {}", "正则表达式无效：{}"
NO_FORMAT, NOT_A_SIZE, SIZES = "字段格式规则必须配置 format 或 pattern", "字号必须是数字", "最小字号不能大于最大字号"
USES_MODEL, NO_RULES = "该规则会调用外部 AI，请确认授权、时延和成本", "规则集当前没有规则"

Fault = tuple[str, str]
_PYTHON = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool}


def _is(value: Any, kind: str) -> bool:
    return isinstance(value, _PYTHON[kind]) and not (isinstance(value, bool) and kind in ("integer", "number"))


def _misfits(value: Any, shape: Any, path: str) -> list[Fault]:
    """What of a value doesn't fit a shape. Entries of a mapping that the shape doesn't name are free."""
    kind, _, least = shape.partition(">=") if isinstance(shape, str) else ({list: "array", dict: "object", tuple: "string"}[type(shape)], "", "")
    kind = "string" if (pattern := kind == "regex") else kind
    if not _is(value, kind):
        return [(path, TYPE.format(kind))]
    if isinstance(shape, list):
        return [f for i, v in enumerate(value) for f in _misfits(v, shape[0], f"{path}[{i}]")]
    if isinstance(shape, dict):
        return [f for k, v in value.items() if k in shape for f in _misfits(v, shape[k], f"{path}.{k}")]
    if isinstance(shape, tuple):
        return [] if value in shape else [(path, ENUM.format(", ".join(shape)))]
    if pattern:
        try:
            re.compile(value)
        except re.error as e:
            return [(path, PATTERN.format(e))]
    return [(path, LEAST.format(least))] if least and value < int(least) else []


def _more(kind: str, params: dict, path: str) -> list[Fault]:
    """What can't be said of one parameter alone."""
    if kind == "field_format" and isinstance(fields := params.get("fields"), list):
        return [(f"{path}.fields[{i}]", NO_FORMAT) for i, f in enumerate(fields) if isinstance(f, dict) and not (f.get("format") or f.get("pattern"))]
    if kind == "layout_check" and isinstance(body := params.get("body"), dict):
        sizes = {k: body[k] for k in ("min_size", "max_size") if body.get(k) is not None}
        if wrong := [(f"{path}.body.{k}", NOT_A_SIZE) for k, v in sizes.items() if not _is(v, "number")]:
            return wrong
        return [(f"{path}.body", SIZES)] if len(sizes) == 2 and sizes["min_size"] > sizes["max_size"] else []
    return []


def faults(rules: RuleSet) -> list[Fault]:
    """(path, message) of every fault. Types that are registered but not in the catalogue take any parameters."""
    found, seen = [], set()
    for i, r in enumerate(rules.rules):
        at = f"rules[{i}]"
        if r.id in seen:
            found.append((f"{at}.id", TWICE.format(r.id)))
        seen.add(r.id)
        if r.type not in PARAMETERS and r.type not in registered():
            found.append((f"{at}.type", UNKNOWN.format(r.type)))
            continue
        params = r.params if isinstance(r.params, dict) else {}
        found += [(f"{at}.params.{name}", MISSING) for name in REQUIRED.get(r.type, ()) if name not in params]
        found += _misfits(r.params, PARAMETERS.get(r.type, {}), f"{at}.params") + _more(r.type, params, f"{at}.params")
    return found


def uses_model(kind: str, params: dict) -> bool:
    """Whether a rule may send a document's text to a model."""
    return kind in NEEDS_MODEL or (kind == "reference_format" and bool(params.get("semantic_review")))


def warnings(rules: RuleSet) -> list[Fault]:
    found = [(f"rules[{i}]", USES_MODEL) for i, r in enumerate(rules.rules) if r.enabled and uses_model(r.type, r.params)]
    return found if rules.rules else [("rules", NO_RULES)]


def known_types() -> list[str]:
    """The catalogue's types, then registered ones that it doesn't have."""
    return [*PARAMETERS, *sorted(set(registered()) - set(PARAMETERS))]
