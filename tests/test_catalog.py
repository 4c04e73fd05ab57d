"""The catalogue of parameters, and every type of its rules against the registry."""

import subprocess
import sys
from pathlib import Path

import pytest

from foliant.operators import checks  # noqa: F401  registers the rule operators
from foliant.plans import catalog
from foliant.plans.rules import NEEDS_MODEL, OPERATORS, Rule, RuleSet


def faults(kind, params, **more):
    return catalog.faults(RuleSet("s", "s", (Rule("R01", kind, params=params, **more),)))


def test_all_types_are_known():
    assert {*OPERATORS, *NEEDS_MODEL} == set(catalog.PARAMETERS) and len(catalog.PARAMETERS) == 20
    assert catalog.known_types()[:2] == ["required_sections", "section_order"]


@pytest.mark.parametrize(("kind", "params", "path", "message"), [
    ("page_limit", {}, "rules[0].params.max_pages", "缺少必填参数"),
    ("page_limit", {"max_pages": "3"}, "rules[0].params.max_pages", "参数类型应为 integer"),
    ("page_limit", {"max_pages": True}, "rules[0].params.max_pages", "参数类型应为 integer"),
    ("page_limit", {"max_pages": 0}, "rules[0].params.max_pages", "参数不能小于 1"),
    ("section_order", {"expected_order": ["a", 2]}, "rules[0].params.expected_order[1]", "参数类型应为 string"),
    ("required_fields", {"fields": [{"name": "a"}, {"name": "b", "normalize": "upper"}]}, "rules[0].params.fields[1].normalize", "参数必须是：text, casefold, phone, date, number, list"),
    ("field_format", {"fields": [{"name": "a"}]}, "rules[0].params.fields[0]", "字段格式规则必须配置 format 或 pattern"),
    ("layout_check", {"body": {"min_size": 14, "max_size": 12}}, "rules[0].params.body", "最小字号不能大于最大字号"),
    ("layout_check", {"body": {"min_size": "x", "max_size": 12}}, "rules[0].params.body.min_size", "字号必须是数字"),
    ("no_such", {}, "rules[0].type", "未知检查器：no_such"),
    ("font_check", [], "rules[0].params", "参数类型应为 object"),
])
def test_faults(kind, params, path, message):
    assert faults(kind, params) == [(path, message)]


def test_more_faults():
    (path, message), = faults("budget_check", {"total_field": "("})
    assert path.endswith("total_field") and message.startswith("正则表达式无效：")
    assert faults("field_format", {"fields": [{"name": "a", "format": "email"}, {"name": "b", "pattern": "x+"}]}) == []
    assert faults("word_limit", {"max_words": 5, "unknown": object()}) == [] and faults("font_check", {"body_size": 10.5}) == []
    twice = RuleSet("s", "s", (Rule("R01", "budget_check"), Rule("R01", "budget_check")))
    assert catalog.faults(twice) == [("rules[1].id", "规则 ID 重复：R01")]


def test_warnings():
    of = lambda *rules: catalog.warnings(RuleSet("s", "s", rules))
    assert of() == [("rules", "规则集当前没有规则")]
    assert [p for p, _ in of(Rule("R01", "budget_check"), Rule("R02", "anonymity_check"), Rule("R03", "reference_format", params={"semantic_review": True}), Rule("R04", "reference_format"), Rule("R05", "anonymity_check", enabled=False))] == ["rules[1]", "rules[2]"]


def test_registry_in_a_fresh_process():
    """The registry fills itself, whichever module comes first, and faults have their places."""
    code = "from foliant.plans import catalog, rules; r = rules.load('id: a\\nrules: [{id: R01, type: page_limit, params: {max_pages: 3}}]'); print(len(catalog.known_types()), len(catalog.faults(r)), catalog.faults(rules.read('id: a\\nrules: [{id: R01, type: odd}]'))[0][0])"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[1], check=True)
    assert out.stdout.split()[:2] == ["20", "0"] and out.stdout.split()[2].startswith("rules[0]")
