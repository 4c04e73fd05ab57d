"""Rule operators on hand-built documents: what passes, what triggers, and the bounds."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from foliant.functions import formats
from foliant.plans import ir, review
from foliant.plans.rules import Rule, RuleError, RuleSet, load


def block(i, kind="paragraph", text="", level=0, page=1, table=None, warnings=(), y0=100.0, font="SimSun", size=12.0):
    return {"ord": i, "id": f"b{i + 1}", "page": page, "type": kind, "level": level, "text": text, "bbox": {"x0": 72.0, "y0": y0, "x1": 500.0, "y1": y0 + 12}, "font": {"name": font, "size": size, "bold": False, "italic": False, "color": 0}, "table_data": table, "parse_warnings": list(warnings), "words": len(text.replace("\n", "").replace(" ", ""))}


def document(spark, blocks, pages=5, ocr=(), statuses=None, words=None):
    blocks = [b | {"ord": i, "id": f"b{i + 1}"} for i, b in enumerate(blocks)]
    meta = [{"page_number": p, "width": 595.0, "height": 842.0, "status": (statuses or {}).get(p, "ok")} for p in range(1, pages + 1)]
    row = {"doc_id": "d", "filename": "d", "pages": pages, "word_count": sum(b["words"] for b in blocks) if words is None else words, "ocr_pages": list(ocr), "parse_warnings": [], "page_meta": meta, "blocks": blocks}
    return spark.createDataFrame([(json.dumps(row, ensure_ascii=False),)], "j string").select(F.from_json("j", ir.DOCUMENT).alias("x")).select("x.*")


def found(spark, type_, params, blocks, severity="error", **kw):
    rules = RuleSet("t", "t", (Rule("R01", type_, severity, params=params),))
    return [(r.severity, r.message, r.page, r.block_id) for r in review.findings(document(spark, blocks, **kw), rules).orderBy("rule_ord", "seq").collect()]


H = lambda t, level=1, page=1: block(0, "heading", t, level, page)
P = lambda t, page=1, **kw: block(0, "paragraph", t, 0, page, **kw)
T = lambda rows, page=1, warnings=(): block(0, "table", " | ".join(" ".join(r) for r in rows), 0, page, rows, warnings)
STANDARD = [H("一、立项依据"), P("依据" * 30), H("二、研究内容"), P("内容" * 10), H("1. 细节", 2), P("细节" * 5), H("三、经费预算"), H("四、参考文献")]


def test_required_sections(spark):
    assert found(spark, "required_sections", {"sections": [{"title": "立项|依据"}, {"title": "研究内容", "min_words": 30}]}, STANDARD) == []
    assert found(spark, "required_sections", {"sections": [{"title": "研究内容", "min_words": 35}, {"title": "附件|材料"}]}, STANDARD) == [
        ("error", "章节「二、研究内容」字数不足（34字 < 35字）", None, None),
        ("error", "缺少必填章节：附件", None, None),
    ]


def test_section_order(spark):
    order = {"expected_order": ["立项依据", "经费预算", "研究内容", "参考文献"]}
    assert found(spark, "section_order", order, STANDARD) == [("error", "章节顺序不符合预期：「经费预算」应在第2位", None, None)]
    assert found(spark, "section_order", {"expected_order": ["立项依据", "研究内容"]}, STANDARD) == []


def test_limits(spark):
    assert found(spark, "page_limit", {"max_pages": 4}, STANDARD) == [("error", "总页数超出限制（5页 > 4页）", 5, None)]
    assert found(spark, "page_limit", {"max_pages": 5}, STANDARD) == []
    paged = [H("一、甲", page=1), H("二、乙", page=2), H("三、丙", page=5)]
    assert found(spark, "page_limit", {"section_limits": {"乙": 2, "丙": 1}}, paged) == [("error", "章节「二、乙」页数超限（3页 > 2页）", 2, None)]
    assert found(spark, "word_limit", {"max_words": 10, "section_limits": {"立项": 59}}, STANDARD, words=11) == [
        ("error", "总字数超出限制（11字 > 10字）", None, None),
        ("error", "章节「一、立项依据」字数超限（60字 > 59字）", 1, None),
    ]


def test_fonts(spark):
    body = [P("正文", font="ABCDEF+SimHei", size=10.5)] * 2 + [P("正文", font="SimSun", size=12.0)]
    assert found(spark, "font_check", {}, body) == [("error", "正文字体不符合要求（检测为ABCDEF+SimHei，要求宋体）", None, None), ("error", "正文字号不符合要求（检测为10.5pt，要求12pt）", None, None)]
    assert found(spark, "font_check", {}, [P("正文")], ocr=(2,)) == [("info", "第 [2] 页使用 OCR，无法可靠验证原始字体和字号", None, None)]


def test_page_numbers(spark):
    text = [P("x", page=p) for p in range(1, 6)]
    foot = lambda p, n: P(f"- {n} -", page=p, y0=800.0)
    assert found(spark, "page_number_check", {}, text + [foot(p, p) for p in range(2, 6)]) == []
    assert found(spark, "page_number_check", {}, text) == [("info", "未检测到可验证的页脚页码", None, None)]
    assert found(spark, "page_number_check", {}, text[:4] + [foot(2, 2), foot(3, 4)]) == [
        ("error", "第5页无内容", 5, None), ("error", "以下页面未检测到页码：[4, 5]", None, None), ("error", "页码不连续：[2, 4]", None, None)]


def test_figures(spark):
    assert found(spark, "figure_table_numbering", {}, [P("图1 结构"), P("见图 3 和表2")]) == [
        ("error", "图编号不连续，缺少：图2", None, None), ("error", "表编号不连续，缺少：表1", None, None), ("error", "图题注缺失：图3", None, None)]
    assert found(spark, "figure_table_numbering", {}, [P("图1 结构"), P("图2 流程")]) == []


BUDGET = [["科目", "金额（万元）"], ["设备费", "6.0"], ["管理费", "1.0"], ["合计", "7.0"]]


def test_budget(spark):
    assert found(spark, "budget_check", {"max_ratio": {"管理费": 0.2}}, [T(BUDGET)]) == []
    off = [r[:] for r in BUDGET]
    off[3][1] = "8.0"
    assert found(spark, "budget_check", {"max_ratio": {"管理费": 0.1}}, [P("x"), T(off, page=3)]) == [
        ("error", "预算勾稽不平：分项合计 7.0 ≠ 总额 8.0", 3, "b2"), ("error", "「管理费」占比 12.5% 超过上限 10%", 3, "b2")]
    assert found(spark, "budget_check", {}, [P("x")]) == [("error", "未找到经费预算表", None, None)]
    assert found(spark, "budget_check", {}, [T([["a", "b"]], 2, ["第2页表格行为空"])]) == [("info", "存在 1 处表格结构未能可靠解析（第 2 页），无法确认经费预算表内容", 2, "b1")]
    odd = [*BUDGET[:2], ["管理费", "约一"], BUDGET[3]]
    assert [x[1] for x in found(spark, "budget_check", {}, [T(odd)])] == ["预算勾稽不平：分项合计 6.0 ≠ 总额 7.0", "预算表有 1 行金额无法可靠解析"]


def test_dates(spark):
    assert found(spark, "date_check", {"expected_months": 24}, [P("研究期限：2026年1月至2027年12月")]) == []
    assert found(spark, "date_check", {"expected_months": 12}, [P("起止时间：2027年 1月 - 2026年12月", page=2)]) == [
        ("error", "研究期限日期异常：开始日期 2027年1月 不早于结束日期", 2, "b1"), ("error", "研究期限 2 个月，与指南要求的 12 个月不一致", None, None)]


def test_attachments_and_signatures(spark):
    assert [x[:2] for x in found(spark, "attachment_checklist", {"expected": ["伦理审查批件", "合同"]}, [P("附：伦理审查 批件")])] == [("error", "附件清单中「合同」未在正文中出现")]
    assert [x[0] for x in found(spark, "attachment_checklist", {"expected": ["合作协议书"]}, [P("x")], statuses={2: "scanned_no_text"})] == ["info"]
    assert found(spark, "signature_page", {}, [P("签字", page=5)]) == [("error", "末页缺少签字盖章关键字：{'盖章'}", 5, None)]
    assert found(spark, "signature_page", {}, [P("签字 盖章", page=4)]) == [("info", "已找到签字盖章文字，但未检测到可验证的签章图像", None, None)]


def test_fields(spark):
    field = {"fields": [{"name": "负责人", "aliases": ["项目负责人"]}, {"name": "电话"}, {"name": "邮箱", "required": False}]}
    assert found(spark, "required_fields", field, [P("项目负责人：张三  电话：____")]) == [("error", "必填字段「电话」未填写", 1, "b1")]
    assert found(spark, "required_fields", field, [T([["负责人", "", "张三"], ["电话：", "13800138000"]])]) == []
    assert found(spark, "field_format", {"fields": [{"name": "邮箱", "format": "email"}, {"name": "编号", "pattern": "P[0-9]+"}]}, [P("邮箱：a@b.cn"), P("邮箱: bad"), P("编号：P12"), P("编号：Q1")]) == [
        ("error", "字段「邮箱」格式不正确：bad", 1, "b2"), ("error", "字段「编号」格式不正确：Q1", 1, "b4")]


def test_layout(spark):
    lay = lambda b, **kw: b | {"layout": {"alignment": "left", "line_count": 3, "line_spacing_pt": 20.0, "first_line_indent_pt": 24.0} | kw}
    body = [H("一、甲", page=1), lay(P("正文" * 20, page=1)), lay(P("正文" * 20, page=2), alignment="center", line_spacing_pt=30.0)]
    run = lambda params: [x[1:] for x in found(spark, "layout_check", params, body, pages=2)]
    assert run({"page": {"size": "A4"}, "margins_mm": {"left_min": 25, "top_min": 30}, "body": {"min_size": 12, "max_size": 12}}) == []
    assert run({"page": {"size": "A4", "orientation": "landscape"}, "margins_mm": {"left_min": 26, "bottom_min": 300}}) == [
        ("页面尺寸或方向不符合 A4 landscape 要求：第[1, 2]页", 1, None), ("第[1, 2]页左边距小于 26mm", 1, None), ("第[1, 2]页下边距小于 300mm", 1, None)]
    assert run({"body": {"min_size": 13, "alignment": "left", "line_spacing_pt": 20, "first_line_indent_min_pt": 30}}) == [
        ("正文主字号 12.0pt 小于要求 13pt", None, None), ("检测到 1 个正文段落未按 left 对齐", 2, "b3"), ("检测到 1 个正文段落的行距不符合配置要求", 2, "b3"), ("检测到 2 个正文段落的首行缩进不符合配置要求", 1, "b2")]
    assert run({"headings": {"1": {"font": "黑体", "size": 16, "bold": True}}}) == [("第1级标题版式不符合要求：字体为SimSun，要求黑体；字号为12.0pt，要求16pt；未加粗", 1, "b1")]
    assert found(spark, "layout_check", {"page": {"size": "B9"}}, body)[0][1].startswith("规则 R01 执行失败")


def test_cross_field_consistency(spark):
    run = lambda params, *ts: [x[1] for x in found(spark, "cross_field_consistency", params, [P(t) for t in ts])]
    money = {"fields": [{"name": "经费", "normalize": "number", "tolerance": 1}]}
    assert run(money, "经费：1.2万元", "经费：12,000") == []
    assert run(money, "经费：1.2万", "经费：12002") == ["「经费」在多处取值不一致：1.2万 / 12002"]
    assert run(money, "经费：若干", "经费：12002") == ["「经费」无法进行一致性比较：无法识别数字“若干”"]
    assert run({"fields": [{"name": "题目", "validation_pattern": ".{1,3}"}]}, "题目：甲乙丙丁。", "题目：甲乙 丙丁") == ["「题目」格式不符合规则：甲乙丙丁。"]
    assert run({"fields": [{"name": "编号", "pattern": r"No\.(?P<value>\d+)"}]}, "编号：12", "x No.12", "y No.13") == ["「编号」在多处取值不一致：12 / 13"]
    dates = {"comparisons": [{"left": {"name": "开始"}, "right": {"name": "起始"}, "normalize": "date"}]}
    assert run(dates, "开始：2026年1月2日", "起始：2026-01-02") == []
    assert run(dates, "开始：2026年1月3日", "起始：2026-01-02") == ["字段间取值不一致：「开始」为 2026年1月3日，「起始」为 2026-01-02"]
    assert run(dates, "开始：2026年2月30日", "起始：2026-01-02") == ["字段间无法进行一致性比较：日期无效“2026年2月30日”"]
    assert run(dates, "开始：2026年1月3日") == []
    phones = {"fields": [{"name": "电话", "normalize": "phone"}, {"name": "成员", "normalize": "list"}]}
    assert run(phones, "电话：+86 138-0013-8000", "电话：13800138000", "成员：张三、li", "成员：LI 张三") == []


def test_heading_numbering(spark):
    h = lambda *ts: [H(t, page=2) for t in ts]
    run = lambda params, *ts: [x[1] for x in found(spark, "heading_numbering", params, h(*ts))]
    assert run({}, "一、甲", "1.1 乙", "1.2 丙", "二、丁", "2.1 戊") == []
    assert run({}, "一、甲", "三、乙") == ["标题编号不连续：1 后出现 三、"]
    assert run({}, "1. 甲", "1.1.1 乙") == ["标题层级从第1级跳到第3级：1.1.1"]
    assert run({}, "1. 甲", "2.1 乙") == ["标题编号父级不匹配：2.1"]
    assert run({}, "一、甲", "2. 乙") == ["第1级标题混用编号样式：chinese / arabic"]
    assert run({"allow_mixed_styles": True}, "一、甲", "2. 乙") == []
    assert run({"require_numbering": True, "allowed_styles": {1: "chinese"}}, "前言", "1. 甲") == ["标题未使用可识别编号：前言", "第1级标题编号样式不符合要求：1."]
    assert run({"max_issues": 1}, "1. 甲", "3. 乙", "5. 丙") == ["标题编号不连续：1 后出现 3."]
    assert found(spark, "heading_numbering", {}, [H("1. 甲"), H("9. 乙")]) == []  # page 1 is skipped


def test_chinese_numerals(spark):
    from foliant.operators.checks import chinese_number

    ones = "零一二三四五六七八九"
    spoken = lambda n: (ones[n // 100] + "百" if n >= 100 else "") + (ones[n % 100 // 10] if n % 100 >= 20 or (n > 100 and n % 100 >= 10) else "") + ("十" if n % 100 >= 10 else "") + (ones[n % 10] if n % 10 else "")
    rows = spark.createDataFrame([(n, spoken(n)) for n in range(1, 200) if n % 100 >= 10 or n < 10 or n == 100], "n int, s string")
    assert [r.n for r in rows.where(chinese_number(F.col("s")).isNull() | (chinese_number(F.col("s")) != F.col("n"))).collect()] == []


def test_references(spark):
    text = "[1] 张三. 题名[J]. 期刊, 2020.\n续行\n[2] 李四. 无年份[M].\n[3] 王五, 2019."
    assert found(spark, "reference_format", {}, [H("参考文献"), P(text, page=4), H("附录"), P("[9] x")]) == [
        ("error", "参考文献条目缺少：出版年份", 4, "b2"), ("error", "参考文献条目缺少：文献类型标识", 4, "b2")]
    assert [x[1] for x in found(spark, "reference_format", {}, [H("参考文献"), P("1. 甲[J] 2001"), P("2020) 不是条目"), P("2. 乙")])] == ["参考文献条目缺少：出版年份、文献类型标识"]
    assert found(spark, "reference_format", {}, [P("[1] x")]) == []


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("date", ["2026年6月30日", "2026-2-28", "2026 / 02 / 28", "2024.2.29"], ["2026年2月30日", "0000-01-01", "2026-13-01", "26-1-1", "2026年6月\n30日"]),
        ("cn_mobile", ["13800138000", "+86 138-0013-8000"], ["12800138000", "1380013800"]),
        ("phone", ["010-62770000", "13800138000"], ["62770000"]),
        ("cn_id", ["11010519491231002X"], ["110105194912310021", "11010519491331002X"]),
        ("number", ["1,000.5", "-3", "12万", "￥12元"], ["1.2.3", "x"]),
        ("email", ["a.b@c.cn"], ["a@b", "a@b.c\n"]),
        ("project_code", ["AB_12-3"], ["AB", "-ABC"]),
    ],
)
def test_formats(spark, kind, good, bad):
    rows = spark.createDataFrame([(v,) for v in good + bad], "v string").select("v", formats.VALIDATORS[kind](F.col("v")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True] * len(good) + [False] * len(bad)


def test_conclusion_table(spark):
    """An error never hides what is incomplete, and nothing incomplete passes."""
    for manual, failed, error in itertools.product([False, True], repeat=3):
        rules = [Rule("R00", "page_limit", params={"max_pages": 99})]
        rules += [Rule("R01", "page_limit", params={"max_pages": 1})] if error else []
        rules += [Rule("R02", "signature_page", params={"keywords": ["签字"]})] if manual else []
        rules += [Rule("R03", "field_format", params={"fields": [{"name": "x"}]})] if failed else []
        s = review.summary(document(spark, [P("签字", page=5)]), RuleSet("t", "t", tuple(rules))).first()
        assert s.conclusion == ("incomplete" if manual or failed else "needs_revision" if error else "pass"), (manual, failed, error)
        assert s.failed_checks == int(failed) and s.manual_required_checks == int(manual)
    assert review.summary(document(spark, []), RuleSet("t", "t", ())).first().conclusion == "incomplete"


def test_rule_sets():
    assert load("{id: a, name: n, rules: [{id: R01, type: page_limit, params: {max_pages: 3}}]}").rules[0].params == {"max_pages": 3}
    for bad in ("{id: 'a b', rules: []}", "{id: a, rules: [{id: R01, type: nope}]}", "{id: a, rules: [{id: R01, type: page_limit}, {id: R01, type: page_limit}]}", "{id: a, rules: [{id: R01, type: page_limit, severity: bad}]}"):
        with pytest.raises(RuleError):
            load(bad)
