"""Rules that ask a model: chunks, evidence, faults of the provider."""

import random

from foliant.operators import model_rules as M
from foliant.plans.rules import Rule
from tests.test_review import H, P, document


def texts(spark, type_, blocks, **params):
    rule = Rule("R01", type_, "warning", params=params)
    return [r.prompt.split("<untrusted_document>\n")[1].split("\n</untrusted")[0] for r in M.prompts(document(spark, blocks), rule).orderBy("chunk").collect()]


def test_chunks(spark):
    body = [P("封面", page=1), P("aaaa", page=2), P(" ", page=2), P("bbbb", page=2), P("cc", page=3)]
    assert texts(spark, "anonymity_check", body, max_chunk_chars=8) == ["aaaa\n\nbbbb", "cc"]
    sections = [H("一、甲"), P("正文一"), H("1. 小", 2), P("正文二"), H("二、乙"), P("丙" * 9)]
    assert texts(spark, "title_content_match", sections, max_section_chars=5) == ["一、甲\n正文一\n正\n\n二、乙\n" + "丙" * 5]
    assert texts(spark, "cross_consistency_semantic", [P("经费10万元。无关。期限两年！"), P("成员三人")]) == ["1. 经费10万元。\n2. 期限两年！\n3. 成员三人"]
    assert texts(spark, "cross_consistency_semantic", [P("无关")]) == []


def test_answers(spark):
    docs = document(spark, [P("负责人张三在某大学工作", page=2), P("其他内容", page=3)])
    rule = Rule("R01", "anonymity_check", "error")
    said = lambda prompt: {"issues": [{"evidence": "张三在 某大学", "message": "m", "suggestion": "s"}, {"evidence": "文中没有"}, "odd"]}
    (r,) = M.asked(docs, rule, said).collect()
    assert (r.severity, r.page, r.block_id, r.confidence, r.layer) == ("error", 2, "b1", "ai", "llm")

    def broken(prompt):
        raise TimeoutError

    (r,) = M.asked(docs, rule, broken).collect()
    assert (r.severity, r.confidence) == ("info", "degraded") and "TimeoutError" in r.message


def test_similar_evidence():
    blocks = [{"id": "a", "text": "完全不同"}, {"id": "b", "text": "项目负责人姓名为张三丰"}]
    assert M.placed("项目负责人姓名是张三丰", blocks)["id"] == "b" and M.placed("毫不相干的话", blocks) is None


def test_places_by_bound_are_those_of_every_ratio(monkeypatch):
    random.seed(9)
    calls = []
    real = M.SequenceMatcher

    def counting(*args):
        calls.append(args)
        return real(*args)

    monkeypatch.setattr(M, "SequenceMatcher", counting)
    made = 0
    for _ in range(150):
        base = "".join(random.choice("项目经费总额万元成员人数年月ab") for _ in range(random.randint(5, 60)))
        blocks = []
        for i in range(30):
            t = list(base if random.random() < 0.4 else "".join(random.choice("其他内容文字cdef") for _ in range(random.randint(0, 60))))
            for _ in range(random.randint(1, 9)):
                t.insert(random.randint(0, len(t)), random.choice("xyz项 "))
            blocks.append({"text": "".join(t), "id": i})
        blocks += [{"text": None, "id": 30}, {"text": blocks[0]["text"], "id": 31}]
        ratios = [(real(None, base, "".join((b["text"] or "").split())).ratio() if b["text"] else 0.0) for b in blocks]
        held = [b for b in blocks if b["text"] and base in "".join(b["text"].split())]
        want = held[0]["id"] if held else max(range(len(blocks)), key=lambda i: (ratios[i], -i)) if max(ratios) >= M.SIMILAR else None
        got = M.placed(base, blocks)
        assert (got and got["id"]) == want
        made += len(blocks)
    assert 0 < len(calls) < made / 4
    assert M.placed("", [{"text": "", "id": 1}]) is None and M.placed("a", []) is None
