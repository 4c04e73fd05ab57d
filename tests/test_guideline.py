"""Requirements to rules: every kind in several spellings, what is dropped, numbering, equal ones, text that is none."""

import json

import pytest

from foliant.plans import guideline

CASES = [
    ("page_limit", {"max_pages": 30}, {"max_pages": 30}), ("page_limit", {"pages": " 12 "}, {"max_pages": 12}), ("page_limit", {"limit": 7.9}, {"max_pages": 7}), ("page_limit", {"limit": "7.9"}, None), ("page_limit", {"max_pages": None, "limit": 3}, None),
    ("page_limit", {"pages": [3]}, None), ("page_limit", {"pages": True}, {"max_pages": 1}), ("page_limit", {}, None), ("page_limit", "text", None), ("page_limit", None, None), ("word_limit", {"words": "1_000"}, {"max_words": 1000}),
    ("required_section", {"sections": ["a", "", None, 'b "q"', 3, False]}, {"sections": [{"title": "a"}, {"title": 'b "q"'}, {"title": "3"}]}), ("required_section", {"sections": [], "section": "x"}, {"sections": [{"title": "x"}]}), ("required_section", {"sections": [], "section": ""}, {"sections": [{"title": ""}]}), ("required_section", {"names": []}, None),
    ("font", {"font": "宋体", "size": "12"}, {"body_font": "宋体", "body_size": 12}), ("font", {"body_size": 10.5}, {"body_size": 10.5}), ("font", {"body_font": "", "size": "big"}, None),
    ("budget_ratio", {"name": "fee", "ratio": "0.05"}, {"max_ratio": {"fee": 0.05}}), ("budget_ratio", {"item": "fee"}, None), ("budget_ratio", {"category": 'a"b', "limit": 1.0}, {"max_ratio": {'a"b': 1}}),
    ("duration", {"months": 24}, {"expected_months": 24}), ("duration", {"months": "two years"}, None), ("attachment", {"name": "letter"}, {"expected": ["letter"]}), ("attachment", {"expected": ["a", "b"]}, {"expected": ["a", "b"]}), ("required_field", {"names": "phone"}, {"fields": [{"name": "phone"}]}), ("required_field", {}, None),
    ("field_format", {"name": "f", "format": " email "}, {"fields": [{"name": "f", "format": "email"}]}), ("field_format", {"name": "f", "format": "zip"}, None), ("field_format", {"field": "f", "pattern": "\\d+", "expected": "digits"}, {"fields": [{"name": "f", "pattern": "\\d+", "expected": "digits"}]}),
    ("field_format", {"field": "f", "pattern": "x", "expected": ""}, {"fields": [{"name": "f", "pattern": "x"}]}), ("field_format", {"name": "f"}, None), ("field_format", {"format": "email"}, None),
    ("heading_numbering", {}, {"require_numbering": True, "allow_mixed_styles": False}), ("heading_numbering", {"require_numbering": 0, "allow_mixed_styles": "x", "allowed_styles": {"1": "a"}}, {"require_numbering": False, "allow_mixed_styles": True, "allowed_styles": {"1": "a"}}),
    ("layout", {}, {"page": {"size": "A4", "orientation": "portrait"}}), ("layout", {"size": "a3", "orientation": "any", "margins": {"top": 20}, "body": [], "headings": {}}, {"page": {"size": "A3", "orientation": "any"}, "margins_mm": {"top": 20}, "headings": {}}), ("layout", {"page_size": "B5"}, None), ("layout", {"orientation": "up"}, None),
    ("unknown", {"a": 1}, None), (None, {"a": 1}, None), (3, {"a": 1}, None),
]


@pytest.fixture(scope="module")
def rows(spark):
    given = [("g", i, json.dumps({"detail": detail, "kind": kind}, ensure_ascii=False, indent=i % 3)) for i, (kind, detail, _) in enumerate(CASES)]
    again = [("g", 500 + i, json.dumps({"kind": kind, "detail": detail})) for i, (kind, detail, _) in enumerate(CASES)]
    none = [("g", 1000, None), ("g", 1001, "no json"), ("g", 1002, "[1]"), ("g", 1003, '"x"'), ("h", 1, "{}"), ("h", 2, '{"kind": "duration", "detail": {"months": 6}}')]
    return guideline.mapped(spark.createDataFrame(given + again + none, "guideline string, ord int, requirement string")).collect()


def test_kinds(rows):
    mine = {r.ord: r for r in rows if r.guideline == "g"}
    distinct = {}
    for i, (kind, detail, _) in enumerate(CASES):
        distinct.setdefault(json.dumps([kind, detail], sort_keys=True), i)
    assert sorted(mine) == sorted(distinct.values())
    number = 0
    for i in sorted(mine):
        want = CASES[i][2]
        assert (mine[i].params and json.loads(mine[i].params)) == want, CASES[i]
        if want is None:
            assert mine[i].rule_id is None and mine[i].type is None
        else:
            number += 1
            assert (mine[i].rule_id, mine[i].type, mine[i].severity) == (f"G{number:03d}", *guideline.KINDS[CASES[i][0]]) and mine[i].description == "Generated from guideline"


def test_numbers_by_guideline(rows):
    assert [(r.ord, r.rule_id) for r in sorted(rows, key=lambda r: r.ord) if r.guideline == "h"] == [(1, None), (2, "G001")]


def test_canonical_and_empty(spark):
    texts = ['{"b": [1, 2.50], "a": {"d": null, "c": "é"}}', '{ "a":{"c":"\\u00e9","d":null},"b":[1,2.5] }', "x", None]
    got = [r.c for r in spark.createDataFrame([(t,) for t in texts], "t string").select(guideline.canonical(guideline.F.col("t")).alias("c")).collect()]
    assert got[0] == got[1] == '{"a":{"c":"é","d":null},"b":[1,2.5]}' and got[2:] == [None, None]
    empty = guideline.mapped(spark.createDataFrame([], "guideline string, ord int, requirement string"))
    assert empty.count() == 0 and guideline.dropped(empty).count() == 0
