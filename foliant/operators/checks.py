"""The rule operators: each turns a rule into a column array<finding> over one document's row.

A row holds doc_id, pages, word_count, ocr_pages, page_meta (structs) and blocks (structs in reading order; see plans.ir).
All rules of a rule set are evaluated in one projection over these rows: no joins, no unions, one pass.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions import formats
from foliant.functions.columns import WHITE, finding, given, java, joined, let, mode, none, of, quoted, strip, texts, whole
from foliant.functions.text import casefolded, compatible
from foliant.plans.rules import Rule, RuleError, operator

def BLOCKS() -> Column:  # noqa: N802
    return F.col("blocks")


def PAGES() -> Column:  # noqa: N802
    return F.col("pages")


def META() -> Column:  # noqa: N802
    return F.col("page_meta")


#: Statuses of pages that weren't read in full.
INCOMPLETE = ("scanned_no_text", "scanned_minimal_text", "ocr_insufficient", "ocr_failed", "ocr_skipped_limit", "mixed_image_unread")
#: Words that tell a period of research, and a budget table.
PERIOD, PERIOD_NEAR, BUDGET, AMOUNT_HEADS = ("研究期限", "起止时间", "执行期限", "项目期限"), ("研究期限", "起止时间"), ("预算", "经费", "金额", "合计"), ("金额", "万元", "万")
#: Names of fonts, in the order in which they are tried.
FONTS = {
    "SimSun": "宋体", "NSimSun": "宋体", "宋体": "宋体",
    "SimHei": "黑体", "Hei": "黑体", "黑体": "黑体",
    "KaiTi": "楷体", "KaiTi_GB2312": "楷体", "楷体": "楷体",
    "FangSong": "仿宋", "FangSong_GB2312": "仿宋", "仿宋": "仿宋",
    "MicrosoftYaHei": "微软雅黑",
}
#: What stands for an empty field.
EMPTY_FIELDS = ("", "请填写", "待填写", "未填写", "待补充", "暂缺")


def has(text: Column, *words: str) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def headings(level: int | None = None) -> Column:
    return F.filter(BLOCKS(), lambda b: (b["type"] == "heading") & (F.lit(True) if level is None else b["level"] == level))


def first(blocks: Column) -> Column:
    return F.get(blocks, F.lit(0))


def all_text() -> Column:
    return F.array_join(F.transform(BLOCKS(), lambda b: b["text"]), " ")


def section_words(heading: Column) -> Column:
    """Words of what follows a heading, up to the next heading of its level or above."""
    after = F.slice(BLOCKS(), heading["ord"] + 2, F.size(BLOCKS()))
    state = F.struct(F.lit(False).alias("over"), F.lit(0).cast("long").alias("n"))
    step = lambda s, b: let(s["over"] | ((b["type"] == "heading") & (b["level"] <= heading["level"])), lambda over: F.struct(over.alias("over"), (s["n"] + F.when(over, 0).otherwise(b["words"])).alias("n")))
    return F.aggregate(after, state, step, lambda s: s["n"])


@operator("required_sections")
def required_sections(rule: Rule) -> Column:
    out = []
    for section in rule.params.get("sections", []):
        names, least = str(section.get("title", "")).split("|"), int(section.get("min_words", 0) or 0)
        heads = headings()
        match = F.coalesce(*[first(F.filter(heads, of(lambda h, n=n: has(h["text"], n)))) for n in names])

        def judged(h: Column, names=names, least=least) -> Column:
            missing = given(h.isNull(), finding(rule, texts(f"缺少必填章节：{names[0]}"), f"请添加「{names[0]}」章节"))
            if least <= 0:
                return missing
            # the count starts at the first heading that contains the matched one's text
            start = first(F.filter(headings(), lambda x: F.contains(x["text"], h["text"])))
            short = let(let(start, section_words), lambda n: given(h.isNotNull() & (n < least), finding(rule, texts("章节「", h["text"], "」字数不足（", n, f"字 < {least}字）"), f"请扩充内容至{least}字以上")))
            return F.concat(missing, short)

        out.append(let(match, judged))
    return joined(*out)


@operator("section_order")
def section_order(rule: Rule) -> Column:
    expected = [str(x) for x in rule.params.get("expected_order", [])]
    if len(expected) < 2:
        return none()
    heads = headings(1)
    at = lambda p: F.array_position(F.transform(heads, lambda h: has(h["text"], p)), True)
    places = F.array(*[F.struct(at(p).cast("int").alias("at"), F.lit(expected.index(p)).alias("i")) for p in dict.fromkeys(expected)])
    order = F.sort_array(F.filter(places, lambda x: x["at"] > 0))

    def drops(o: Column) -> Column:
        found = first(F.filter(F.transform(o, lambda x, k: F.struct(x["i"].alias("i"), F.get(o, k - 1)["i"].alias("before"))), lambda x: x["i"] < x["before"]))
        name = lambda i: F.element_at(F.array(*map(F.lit, expected)), i + 1)
        return let(found, lambda d: given(d.isNotNull(), finding(rule, texts("章节顺序不符合预期：「", name(d["i"]), "」应在第", d["i"] + 1, "位"), "请按申报指南要求的顺序调整章节")))

    return let(order, drops)


@operator("page_limit")
def page_limit(rule: Rule) -> Column:
    most, out = rule.params.get("max_pages"), []
    if most is not None:
        out.append(given(PAGES() > most, finding(rule, texts("总页数超出限制（", PAGES(), f"页 > {most}页）"), f"请缩减内容至{most}页以内", page=PAGES())))
    for title, limit in (rule.params.get("section_limits") or {}).items():
        if limit is None:
            continue

        def judged(h: Column, limit=limit) -> Column:
            later = first(F.filter(headings(1), lambda x: x["page"] > h["page"]))
            n = F.coalesce(later["page"] - 1, PAGES()) - h["page"] + 1
            return let(n, lambda n: given(F.coalesce(n > limit, F.lit(False)), finding(rule, texts("章节「", h["text"], "」页数超限（", n, f"页 > {limit}页）"), f"请缩减至{limit}页以内", page=h["page"])))

        out.append(let(first(F.filter(headings(), of(lambda h, t=title: has(h["text"], t)))), judged))
    return joined(*out)


@operator("word_limit")
def word_limit(rule: Rule) -> Column:
    most, out, n = rule.params.get("max_words"), [], F.col("word_count")
    if most is not None:
        out.append(given(n > most, finding(rule, texts("总字数超出限制（", n, f"字 > {most}字）"), f"请缩减至{most}字以内")))
    for title, limit in (rule.params.get("section_limits") or {}).items():
        judged = lambda h, limit=limit: let(section_words(h), lambda n: given(h.isNotNull() & (n > limit), finding(rule, texts("章节「", h["text"], "」字数超限（", n, f"字 > {limit}字）"), f"请缩减至{limit}字以内", page=h["page"])))
        out.append(let(first(F.filter(headings(), of(lambda h, t=title: has(h["text"], t)))), judged))
    return joined(*out)


def font_name(name: Column) -> Column:
    clean = F.replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\A[A-Z]{6}\+", ""), F.lit(" "), F.lit(""))
    return let(clean, lambda c: F.coalesce(*[F.when(c == k, v) for k, v in FONTS.items()], *[F.when(F.contains(c, F.lit(k)), v) for k, v in FONTS.items()], c))


@operator("font_check")
def font_check(rule: Rule) -> Column:
    font, size = str(rule.params.get("body_font", "宋体")), float(rule.params.get("body_size", 12))
    shown = f"{rule.params.get('body_size', 12)}"
    body = F.filter(BLOCKS(), lambda b: (b["type"] == "paragraph") & ~F.coalesce(F.array_contains("ocr_pages", b["page"]), F.lit(False)))
    name = mode(F.transform(F.filter(body, lambda b: F.coalesce(b["font"]["name"], F.lit("")) != ""), lambda b: b["font"]["name"]))
    most = mode(F.transform(F.filter(body, lambda b: b["font"]["size"] > 0), lambda b: F.bround(b["font"]["size"], 1)))
    other = lambda n: let(font_name(n), lambda f: (f != "") & ~F.contains(f, F.lit(font)))
    wrong = let(name, lambda n: given(n.isNotNull() & other(n), finding(rule, texts("正文字体不符合要求（检测为", n, f"，要求{font}）"), f"请将正文字体改为{font}")))
    off = let(most, lambda s: given(s.isNotNull() & (F.abs(s - size) > 0.5), finding(rule, texts("正文字号不符合要求（检测为", s, f"pt，要求{shown}pt）"), f"请将正文字号改为{shown}pt")))
    scanned = given(F.size("ocr_pages") > 0, finding(rule, texts("第 [", F.array_join(F.col("ocr_pages").cast("array<string>"), ", "), "] 页使用 OCR，无法可靠验证原始字体和字号"), "请人工核对扫描页的原始版式", manual=True))
    return joined(wrong, off, scanned)


@operator("page_number_check")
def page_number_check(rule: Rule) -> Column:
    p = rule.params
    front = int(p.get("allow_unnumbered_front_pages", p.get("allow_unumbered_front_pages", 1)))
    numbers = F.when(PAGES() >= 1, F.sequence(F.lit(1), PAGES())).otherwise(F.array().cast("array<int>"))
    empty = F.transform(F.filter(numbers, lambda n: ~F.exists(BLOCKS(), lambda b: b["page"].eqNullSafe(n))), lambda n: finding(rule, texts("第", n, "页无内容"), "请检查文档是否有空白页", page=n))
    odd = given(F.size(META()) != PAGES(), finding(rule, texts("页码元数据不匹配（meta有", F.size(META()), "条，实际", PAGES(), "页）")))
    height = lambda n: F.coalesce(first(F.reverse(F.filter(META(), lambda m: m["page_number"] == n)))["height"], F.lit(0.0))
    foot = F.filter(BLOCKS(), lambda b: b["page"].isNotNull() & whole(strip(b["text"]), r"[-—–\s]*([0-9]{1,4})[-—–\s]*") & (height(b["page"]) > 0) & (b["bbox"]["y0"] >= height(b["page"]) * 0.82))
    seen = F.transform(foot, lambda b: F.struct(b["page"].alias("page"), F.regexp_extract(b["text"], "([0-9]{1,4})", 1).try_cast("int").alias("n")))
    needed = F.filter(numbers, lambda n: n > front)

    def judged(s: Column) -> Column:
        of = lambda n: first(F.reverse(F.filter(s, lambda x: x["page"] == n)))["n"]  # noqa: E731  the last one on a page counts
        lost = F.filter(needed, lambda n: ~F.exists(s, lambda x: x["page"] == n))
        row = F.filter(F.transform(needed, of), lambda n: n.isNotNull())
        shown = lambda a: texts("[", F.array_join(a.cast("array<string>"), ", "), "]")
        gaps = let(lost, lambda a: given(F.size(a) > 0, finding(rule, texts("以下页面未检测到页码：", shown(a)), "请补充缺失页码并检查页脚位置")))
        broken = let(row, lambda a: given(F.exists(F.transform(a, lambda x, i: (i > 0) & (x != F.get(a, i - 1) + 1)), lambda x: F.coalesce(x, F.lit(False))), finding(rule, texts("页码不连续：", shown(a)), "请重新设置连续页码")))
        unseen = given(F.size(needed) > 0, finding(rule, texts("未检测到可验证的页脚页码"), "请人工确认页码是否存在且连续", manual=True))
        return F.when((F.size(needed) > 0) & (F.size(s) == 0), unseen).otherwise(F.concat(gaps, broken))

    return joined(empty, odd, let(seen, judged))


def labels(label: str, numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: texts(label, n)), "、")


@operator("figure_table_numbering")
def figure_table_numbering(rule: Rule) -> Column:
    def numbers(label: str) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(all_text(), F.lit(rf"(?U){label}\s*(\d+)"), F.lit(1)), lambda x: formats.ascii_digits(x).try_cast("int")), lambda n: n.isNotNull())))

    def gaps(label: str) -> Column:
        missing = lambda ns: F.when(F.coalesce(F.array_max(ns), F.lit(0)) > 0, F.array_except(F.sequence(F.lit(1), F.array_max(ns)), ns)).otherwise(F.array().cast("array<int>"))
        return let(let(numbers(label), missing), lambda m: given(F.size(m) > 0, finding(rule, texts(f"{label}编号不连续，缺少：", labels(label, m)), f"请检查{label}编号是否跳号")))

    caption = r"(?U)\A\s*图\s*(\d+)\s*[^所示]"
    captions = F.transform(F.filter(BLOCKS(), lambda b: F.regexp_like(b["text"], F.lit(caption))), lambda b: formats.ascii_digits(F.regexp_extract(b["text"], caption, 1)).try_cast("int"))
    bare = let(captions, lambda c: let(F.array_sort(F.array_except(numbers("图"), c)), lambda m: given((F.size(c) > 0) & (F.size(m) > 0), finding(rule, texts("图题注缺失：", labels("图", m)), "请补充对应图的题注行"))))
    return joined(gaps("图"), gaps("表"), bare)


def row_text(row: Column) -> Column:
    return F.array_join(row, " ")


def fixed1(c: Column) -> Column:
    """A decimal with one digit after the point, half-even."""
    return F.bround(c, 1).cast("decimal(38,1)").cast("string")


@operator("budget_check")
def budget_check(rule: Rule) -> Column:
    caps, total_words = rule.params.get("max_ratio") or {}, str(rule.params.get("total_field", "合计|总计"))
    re.compile(total_words)
    tables = F.filter(BLOCKS(), lambda b: b["type"] == "table")
    degraded = F.filter(tables, lambda t: F.size(F.coalesce(t["parse_warnings"], F.array().cast("array<string>"))) > 0)
    budget = first(F.filter(tables, lambda t: F.coalesce(F.exists(t["table_data"], lambda r: has(row_text(r), *BUDGET)), F.lit(False))))

    def without(d: Column) -> Column:
        pages = F.array_sort(F.array_distinct(F.filter(F.transform(d, lambda t: t["page"]), lambda p: p.isNotNull())))
        shown = F.when(F.size(pages) > 0, F.array_join(pages.cast("array<string>"), "、")).otherwise("未知页")
        unsure = finding(rule, texts("存在 ", F.size(d), " 处表格结构未能可靠解析（第 ", shown, " 页），无法确认经费预算表内容"), "请人工核对预算表及相关表格的实际内容", page=first(d)["page"], block=first(d)["id"], manual=True)
        return F.when(F.size(d) > 0, F.array(unsure)).otherwise(F.array(finding(rule, texts("未找到经费预算表"), "请确认申报书包含经费预算表")))

    def with_table(t: Column) -> Column:
        at = {"page": t["page"], "block": t["id"]}
        warnings = F.coalesce(t["parse_warnings"], F.array().cast("array<string>"))
        unsure = given(F.size(warnings) > 0, finding(rule, texts("预算表结构存在解析降级：", F.array_join(F.slice(warnings, 1, 2), "；")), "请人工核对预算表的合并单元格与空行", manual=True, **at))
        rows = t["table_data"]
        body = F.slice(rows, 2, F.size(rows))
        columns = F.sequence(F.lit(0), F.size(first(rows)) - 1)
        by_head = F.array_position(F.transform(first(rows), lambda h: has(h, *AMOUNT_HEADS)), True) - 1
        counts = F.transform(columns, lambda c: F.struct(F.size(F.filter(body, lambda r: formats.amount(F.get(r, c)).isNotNull())).alias("n"), (-c).alias("c")))
        by_count = F.array_max(F.filter(counts, lambda x: (x["n"] > 0) & ((x["c"] < 0) | (x["n"] < F.size(rows) - 1))))
        column = F.when(F.size(first(rows)) > 0, F.when(by_head >= 0, by_head.cast("int")).otherwise(-by_count["c"]))

        def amounts(c: Column) -> Column:
            parsed = F.transform(rows, lambda r, i: F.struct(row_text(r).alias("text"), formats.amount(F.get(r, c)).alias("v"), (F.regexp_like(row_text(r), F.lit(java(total_words)))).alias("total"), (i > 0).alias("body"), (c < F.size(r)).alias("there"), strip(F.coalesce(F.get(r, c), F.lit(""))).alias("cell")))

            def judged(p: Column) -> Column:
                details = F.filter(p, lambda x: x["body"] & ~x["total"] & x["v"].isNotNull())
                detail = F.aggregate(details, F.lit(0).cast("decimal(38,10)"), lambda a, x: (a + x["v"]).cast("decimal(38,10)"))
                total = F.get(F.reverse(F.filter(p, lambda x: x["body"] & x["total"] & x["v"].isNotNull())), F.lit(0))["v"]
                unread = F.transform(F.filter(p, lambda x: x["body"] & x["v"].isNull() & (x["total"] | (x["there"] & ~x["cell"].isin("", "-", "—")))), lambda x: F.substring(x["text"], 1, 80))
                off = given(F.coalesce(F.abs(detail - total) > F.lit("0.01").cast("decimal(10,2)"), F.lit(False)), finding(rule, texts("预算勾稽不平：分项合计 ", fixed1(detail), " ≠ 总额 ", fixed1(total)), "请检查预算表各分项金额是否与合计一致", **at))
                over = []
                for category, cap in caps.items():
                    limit = F.lit(str(cap)).cast("decimal(20,10)")
                    hit = F.filter(p, of(lambda x, k=category, limit=limit: has(x["text"], k) & x["v"].isNotNull() & F.coalesce(total > 0, F.lit(False)) & F.coalesce(x["v"] > limit * total, F.lit(False))))
                    over.append(F.transform(hit, of(lambda x, k=category, cap=cap: finding(rule, texts(f"「{k}」占比 ", F.format_string("%.1f%%", x["v"].cast("double") / total.cast("double") * 100), f" 超过上限 {cap:.0%}"), f"请将{k}调整至不超过{cap:.0%}", **at))))
                loose = let(unread, lambda u: given(F.size(u) > 0, finding(rule, texts("预算表有 ", F.size(u), " 行金额无法可靠解析"), "请人工核对金额格式、合并单元格和计算公式", evidence=F.array_join(F.slice(u, 1, 3), "；"), manual=True, **at)))
                return F.concat(none(), off, *over, loose)

            lost = F.array(finding(rule, texts("预算表中未找到金额列"), "请确保预算表包含数值金额列", **at))
            return F.when(c.isNull(), lost).otherwise(let(parsed, judged))

        return F.concat(unsure, F.when(F.coalesce(F.size(rows) < 2, F.lit(True)), none()).otherwise(let(column, amounts)))

    return let(budget, lambda t: F.when(t.isNull(), let(degraded, without)).otherwise(with_table(t)))


MONTH = r"(?U)(\d{4})\s*年\s*(\d{1,2})\s*月"


def months(text: Column) -> Column:
    """12 y + m of each "y 年 m 月", in order."""
    part = lambda i: F.transform(F.regexp_extract_all(text, F.lit(MONTH), F.lit(i)), lambda x: formats.ascii_digits(x).try_cast("int"))
    return F.zip_with(part(1), part(2), lambda y, m: F.struct(y.alias("y"), m.alias("m")))


@operator("date_check")
def date_check(rule: Rule) -> Column:
    period = F.filter(BLOCKS(), lambda b: has(b["text"], *PERIOD))
    pairs = F.filter(F.transform(period, lambda b: F.struct(b["page"].alias("page"), b["id"].alias("id"), months(b["text"]).alias("d"))), lambda x: F.size(x["d"]) >= 2)
    bad = first(F.filter(pairs, lambda x: F.get(x["d"], F.lit(0)) >= F.get(x["d"], F.lit(1))))
    start = lambda x: F.get(x["d"], F.lit(0))
    out = [let(bad, lambda x: given(x.isNotNull(), finding(rule, texts("研究期限日期异常：开始日期 ", start(x)["y"], "年", start(x)["m"], "月 不早于结束日期"), "请修正研究起止日期", page=x["page"], block=x["id"])))]
    if expected := rule.params.get("expected_months"):
        around = F.flatten(F.transform(F.filter(BLOCKS(), lambda b: has(b["text"], *PERIOD_NEAR)), lambda b: F.flatten(F.transform(F.slice(BLOCKS(), F.greatest(b["ord"] - 1, F.lit(1)), b["ord"] + 3 - F.greatest(b["ord"] - 2, F.lit(0))), lambda x: months(x["text"])))))
        every = F.concat(F.flatten(F.transform(period, lambda b: months(b["text"]))), around)

        def judged(ds: Column) -> Column:
            n = (F.array_max(ds)["y"] - F.array_min(ds)["y"]) * 12 + F.array_max(ds)["m"] - F.array_min(ds)["m"] + 1
            return given(F.coalesce((F.size(ds) >= 2) & (n != int(expected)), F.lit(False)), finding(rule, texts("研究期限 ", n, f" 个月，与指南要求的 {expected} 个月不一致"), "请按指南调整研究期限"))

        out.append(let(every, judged))
    return joined(*out)


def incomplete_pages() -> Column:
    return F.transform(F.filter(META(), lambda m: m["status"].isin(*INCOMPLETE)), lambda m: m["page_number"])


def page_list(pages: Column) -> Column:
    return F.array_join(pages.cast("array<string>"), "、")


@operator("attachment_checklist")
def attachment_checklist(rule: Rule) -> Column:
    expected = [str(x) for x in rule.params.get("expected", [])]
    if not expected:
        return none()
    bare = lambda name: name.replace(" ", "").replace("\n", "")
    # which of the names' characters the text has, found in one pass over it
    seen = "".join(sorted({c for name in expected for c in bare(name)}))

    def judged(x: Column) -> Column:
        def there(name: str) -> Column:
            n = bare(name)
            whole_name = F.contains(x["hay"], F.lit(n)) if len(n) >= 3 else F.lit(False)
            enough = sum((F.array_contains(x["has"], c).cast("int") for c in n), F.lit(0)) >= F.lit(len(n) * 0.7) if len(n) >= 4 else F.lit(False)
            return whole_name | enough

        out = []
        for name in expected:
            unread = incomplete_pages()
            unsure = finding(rule, texts(f"「{name}」未在已读取文本中出现，但第 ", page_list(unread), " 页未完整读取，无法确认是否缺失"), f"请先完成 OCR 或人工确认{name}是否已附", manual=True)
            lost = finding(rule, texts(f"附件清单中「{name}」未在正文中出现"), f"请确认是否已附上{name}")
            out.append(F.when(there(name), none()).when(F.size(unread) > 0, F.array(unsure)).otherwise(F.array(lost)))
        fine = finding(rule, texts("已找到附件清单文字，但系统无法证明附件文件真实存在"), "请人工核对提交材料中的实际附件文件", manual=True)
        return let(joined(*out), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(fine)))

    marked = lambda hay: F.struct(hay.alias("hay"), F.filter(F.array(*map(F.lit, seen)).cast("array<string>"), lambda c: F.contains(hay, c)).alias("has"))
    return let(let(F.translate(all_text(), " \n", ""), marked), judged)


@operator("signature_page")
def signature_page(rule: Rule) -> Column:
    words = [str(x) for x in rule.params.get("keywords", ["签字", "盖章"])]
    last = F.filter(BLOCKS(), lambda b: (b["page"] >= F.greatest(PAGES() - 1, F.lit(1))) & (b["page"] <= PAGES()))
    every = F.array(*map(F.lit, words)).cast("array<string>")
    text = F.array_join(F.transform(last, lambda b: b["text"]), " ")
    missing = let(text, lambda t: F.array_sort(F.array_distinct(F.filter(every, lambda w: ~F.contains(t, w)))))
    unread = F.filter(incomplete_pages(), lambda p: (p >= F.greatest(PAGES() - 1, F.lit(1))) & (p <= PAGES()))
    shown = lambda m: texts("{", F.array_join(F.transform(m, lambda w: texts("'", w, "'")), ", "), "}")
    images = F.size(F.filter(last, lambda b: b["type"] == "image"))

    def judged(m: Column) -> Column:
        unsure = finding(rule, texts("末页（第 ", page_list(unread), " 页）未完整读取，无法确认签字盖章关键字是否缺失：", shown(m)), "请先完成 OCR 或人工确认末页签字盖章内容", manual=True)
        lost = finding(rule, texts("末页缺少签字盖章关键字：", shown(m)), "请确认申报书末两页包含完整的签字盖章内容", page=PAGES())
        pictured = finding(rule, texts("已找到签字盖章文字，并检测到 ", images, " 个图像块，但系统无法验证图像是否为真实签章（不排除校徽、插图或空白图片）"), "请人工核验签字与盖章的真实性、完整性和清晰度", manual=True)
        plain = finding(rule, texts("已找到签字盖章文字，但未检测到可验证的签章图像"), "请人工确认签字和盖章是否真实、完整且清晰", manual=True)
        return F.when((F.size(m) > 0) & (F.size(unread) > 0), F.array(unsure)).when(F.size(m) > 0, F.array(lost)).when(images > 0, F.array(pictured)).otherwise(F.array(plain))

    return let(missing, judged)


def is_empty(value: Column) -> Column:
    return F.translate(value, WHITE + "_＿-—–/\\.。·", "").isin(*EMPTY_FIELDS)


def trimmed(value: Column) -> Column:
    bare = F.btrim(strip(value), F.lit("|；;"))
    return strip(F.get(F.split(bare, r"(?U)\s+(?=[A-Za-z一-鿿（）()]{2,20}\s*[：:])", 2), F.lit(0)))


def field_names(field: dict) -> list[str]:
    name, more = str(field.get("name", "")).strip(), field.get("aliases", [])
    if not name:
        raise RuleError("a field needs a name")
    more = more.split("|") if isinstance(more, str) else more
    if not isinstance(more, list):
        raise RuleError(f"aliases of {name} must be a list or a string")
    return [x for x in dict.fromkeys([name, *(str(a).strip() for a in more)]) if x]


def field_matches(field: dict) -> Column:
    """array<struct<value, page, id, evidence>> of a field's values beside its labels, in text and in table rows; equal (value, page, block) once."""
    names, kind = field_names(field), "array<struct<value:string,page:int,id:string,evidence:string>>"

    def inline(b: Column, name: str) -> Column:
        p = F.lit(rf"(?U){quoted(name)}\s*[：:]\s*([^\n]{{0,160}})")
        pairs = F.arrays_zip(F.regexp_extract_all(b["text"], p, F.lit(0)).alias("e"), F.regexp_extract_all(b["text"], p, F.lit(1)).alias("v"))
        found = F.transform(pairs, lambda x: F.struct(trimmed(x["v"]).alias("value"), b["page"].alias("page"), b["id"].alias("id"), F.substring(x["e"], 1, 200).alias("evidence")))
        return F.when(F.contains(b["text"], F.lit(name)), found.cast(kind)).when(b["text"].isNotNull(), F.array().cast(kind))

    def in_row(b: Column, cells: Column) -> Column:
        label = lambda n: rf"(?sU)\A{quoted(n)}\s*[：:]?\s*(.*)\z"
        own = lambda c: F.coalesce(*[F.when(F.regexp_like(c, F.lit(label(n).replace("(?sU)", "(?U)"))), trimmed(F.regexp_extract(c, label(n).replace("(?sU)", "(?U)"), 1))) for n in names])

        def found(c: Column, i: Column) -> Column:
            right = F.get(F.filter(F.slice(cells, i + 2, F.size(cells)), lambda x: ~is_empty(x)), F.lit(0))
            value = let(own(c), lambda v: F.when(v.isNull(), None).when(is_empty(v), F.coalesce(trimmed(right), F.lit(""))).otherwise(v))
            return F.struct(value.alias("value"), b["page"].alias("page"), b["id"].alias("id"), F.substring(F.array_join(cells, " | "), 1, 200).alias("evidence"))

        return F.filter(F.transform(cells, found), lambda x: x["value"].isNotNull())

    def of_block(b: Column) -> Column:
        rows = F.coalesce(b["table_data"], F.array().cast("array<array<string>>"))
        cells = F.flatten(F.transform(rows, lambda r: let(F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))), lambda cs: in_row(b, cs).cast(kind))))
        return F.concat(*[inline(b, n) for n in names], cells.cast(kind))

    every = F.flatten(F.transform(BLOCKS(), of_block))
    same = lambda a, b: (a["value"] == b["value"]) & a["page"].eqNullSafe(b["page"]) & a["id"].eqNullSafe(b["id"])
    return let(every, lambda ms: F.filter(ms, lambda m, i: ~F.exists(F.slice(ms, F.lit(1), i), lambda x: same(x, m))))


def fields_of(rule: Rule) -> list[dict]:
    fields = rule.params.get("fields", [])
    if not isinstance(fields, list) or any(not isinstance(f, dict) for f in fields):
        raise RuleError(f"{rule.id}: fields must be a list of mappings")
    return fields


@operator("required_fields")
def required_fields(rule: Rule) -> Column:
    out = []
    for field in fields_of(rule):
        if field.get("required", True) is False:
            continue
        name = field_names(field)[0]

        def judged(ms: Column, name=name) -> Column:
            message = F.when(F.size(ms) > 0, F.lit(f"必填字段「{name}」未填写")).otherwise(F.lit(f"未找到必填字段「{name}」"))
            lost = finding(rule, message, f"请在申报书中完整填写{name}", page=first(ms)["page"], block=first(ms)["id"], evidence=F.coalesce(first(ms)["evidence"], F.lit("")))
            return F.when(F.exists(ms, lambda m: ~is_empty(m["value"])), none()).otherwise(F.array(lost))

        out.append(let(field_matches(field), judged))
    return joined(*out)


@operator("field_format")
def field_format(rule: Rule) -> Column:
    out = []
    for field in fields_of(rule):
        name, kind, pattern = field_names(field)[0], str(field.get("format", "")).strip(), str(field.get("pattern", "")).strip()
        if kind and kind not in formats.VALIDATORS:
            raise RuleError(f"{rule.id}: unknown format {kind!r}")
        if not kind and not pattern:
            raise RuleError(f"{rule.id}: field {name} needs a format or a pattern")
        if not kind:
            try:
                re.compile(pattern)
            except re.error as e:
                raise RuleError(f"{rule.id}: bad pattern of field {name}: {e}") from e
        fits = formats.VALIDATORS[kind] if kind else (lambda v, p=pattern: whole(v, p))
        expected = formats.EXPECTED[kind] if kind else str(field.get("expected", "符合配置的格式"))
        wrong = F.filter(field_matches(field), of(lambda m, fits=fits: ~is_empty(m["value"]) & ~fits(m["value"])))
        out.append(F.transform(wrong, of(lambda m, name=name, expected=expected: finding(rule, texts(f"字段「{name}」格式不正确：", m["value"]), f"请填写{expected}", page=m["page"], block=m["id"], evidence=m["evidence"]))))
    return joined(*out)




#: Chinese digits.
CN_FROM, CN_TO = "零〇一二两三四五六七八九", "001223456789"
#: Kinds of heading numbers in the order in which they are tried: pattern, style, level (0: by the number's parts).
NUMBERINGS = (
    (r"\A(第\s*(\d+)\s*[章节篇]\s*)", "chapter", 1),
    (r"\A(([一二三四五六七八九十百零〇两]+)[、．.]\s*)", "chinese", 1),
    (r"\A([（(]([一二三四五六七八九十百零〇两]+)[）)]\s*)", "chinese_parenthesized", 2),
    (r"\A([（(](\d+)[）)]\s*)", "arabic_parenthesized", 2),
    (r"\A((\d+(?:\.\d+)+)[．.、]?\s*)", "decimal", 0),
    (r"\A((\d+)[．.、]\s*)", "arabic", -1),
)


def chinese_number(c: Column) -> Column:
    """A Chinese numeral up to hundreds as int. A sign that is no digit counts as 1 before 十 and 百, as 0 after 十."""
    digit = lambda s, default: F.when((F.length(s) == 1) & F.contains(F.lit(CN_FROM), s), F.translate(s, CN_FROM, CN_TO).try_cast("int")).otherwise(F.lit(default))

    def below_hundred(s: Column) -> Column:
        left, right = F.regexp_extract(s, r"\A([^十]*)十", 1), F.regexp_extract(s, r"\A[^十]*十(.*)\z", 1)
        plain = F.when(F.regexp_like(s, F.lit(rf"\A[{CN_FROM}]+\z")), F.translate(s, CN_FROM, CN_TO).try_cast("int"))
        return F.when(s == "十", 10).when(F.contains(s, F.lit("十")), digit(left, 1) * 10 + digit(right, 0)).otherwise(plain)

    left, right = F.regexp_extract(c, r"\A([^百]*)百", 1), F.regexp_extract(c, r"\A[^百]*百(.*)\z", 1)
    return F.when(F.contains(c, F.lit("百")), digit(left, 1) * 100 + F.coalesce(below_hundred(right), F.lit(0))).otherwise(below_hundred(c))


def heading_number(text: Column, single: int = 1) -> Column:
    """struct<style, level, numbers, prefix> of a heading's number; null if it has none. The first pattern that fits decides."""
    return let(strip(text), lambda t: _heading_number(t, single))


def _heading_number(t: Column, single: int) -> Column:
    cases = []
    for pattern, style, level in NUMBERINGS:
        p = f"(?U){pattern}"
        raw = F.regexp_extract(t, p, 2)
        numbers = F.array(chinese_number(raw)) if style.startswith("chinese") else F.transform(F.split(formats.ascii_digits(raw), r"\."), lambda x: x.try_cast("int"))
        of = F.size(F.split(raw, r"\.")) if level == 0 else F.lit(single if level < 0 else level)
        made = F.struct(F.lit(style).alias("style"), of.alias("level"), numbers.alias("numbers"), strip(F.regexp_extract(t, p, 1)).alias("prefix"))
        cases.append((F.regexp_like(t, F.lit(p)), F.when(~F.exists(numbers, lambda n: n.isNull()), made)))
    out = F.when(*cases[0])
    for condition, made in cases[1:]:
        out = out.when(condition, made)
    return out


@operator("heading_numbering")
def heading_numbering(rule: Rule) -> Column:
    """Hierarchy, sequence and style of heading numbers. What a fold would carry along is looked up in the headings before."""
    p = rule.params
    single, most, mixed = int(p.get("single_arabic_level", 1)), max(1, int(p.get("max_issues", 20))), bool(p.get("allow_mixed_styles", False))
    allowed = p.get("allowed_styles", {})
    if not isinstance(allowed, dict):
        raise RuleError(f"{rule.id}: allowed_styles must be a mapping by level")
    skip = [int(x) for x in p.get("skip_pages", [1])]
    counted = F.filter(BLOCKS(), lambda b: (b["type"] == "heading") & ~F.coalesce(b["page"].isin(*skip), F.lit(False)))
    issue = lambda x, message, suggestion: finding(rule, message, suggestion, page=x["page"], block=x["id"], evidence=x["text"])
    named = F.transform(counted, lambda b: F.struct(b["page"].alias("page"), b["id"].alias("id"), b["text"].alias("text"), heading_number(b["text"], single).alias("n")))

    def first_phase(x: Column) -> Column:
        unnumbered = given(x["n"].isNull() & F.lit(bool(p.get("require_numbering", False))), issue(x, texts("标题未使用可识别编号：", x["text"]), "请按统一的标题编号体系补充编号"))
        wrong = [none()]
        for level, styles in allowed.items():
            styles = [styles] if isinstance(styles, str) else list(styles or [])
            if styles:
                wrong.append(given(F.coalesce((x["n"]["level"] == int(level)) & ~x["n"]["style"].isin(*styles), F.lit(False)), issue(x, texts("第", x["n"]["level"], "级标题编号样式不符合要求：", x["n"]["prefix"]), f"允许的编号样式：{', '.join(map(str, styles))}")))
        return F.concat(unnumbered, *wrong)

    last = lambda xs: F.get(F.reverse(xs), F.lit(0))
    before = lambda xs, i: F.slice(xs, F.lit(1), i)

    def with_context(xs: Column) -> Column:
        """A level's last number is forgotten once a shallower heading comes: the last heading of at most that level tells."""
        at_level = lambda prior, l: let(last(F.filter(prior, lambda y: y["n"]["level"] <= l)), lambda y: F.when(y["n"]["level"] == l, F.get(F.reverse(y["n"]["numbers"]), F.lit(0))))  # noqa: E731, E741
        levels = lambda x: F.when(x["n"]["level"] > 1, F.sequence(F.lit(1), x["n"]["level"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(xs, lambda x, i: F.struct(
            x["page"].alias("page"), x["id"].alias("id"), x["text"].alias("text"), x["n"].alias("n"),
            F.get(F.reverse(x["n"]["numbers"]), F.lit(0)).alias("number"),
            F.transform(levels(x), lambda l: at_level(before(xs, i), l)).alias("above"),  # noqa: E741
            last(before(xs, i))["n"]["level"].alias("prev_level"),
            last(F.filter(before(xs, i), lambda y: y["n"]["level"] == x["n"]["level"]))["n"]["style"].alias("prior_style"),
        ))

    def second_phase(xs: Column) -> Column:
        context = lambda x: F.transform(x["above"], lambda a: F.coalesce(a, F.lit(0)))
        other = lambda x: F.coalesce(x["prior_style"] != x["n"]["style"], F.lit(False))

        def faults(x: Column, i: Column) -> Column:
            level, prefix = x["n"]["level"], x["n"]["prefix"]
            jump = given(F.coalesce(level > x["prev_level"] + 1, F.lit(False)), issue(x, texts("标题层级从第", x["prev_level"], "级跳到第", level, "级：", prefix), "请补齐中间层级或调整标题级别"))
            known = F.exists(before(xs, i), lambda y: (y["n"]["level"] == level) & other(y))
            style = given(F.lit(not mixed) & other(x) & ~known, issue(x, texts("第", level, "级标题混用编号样式：", x["prior_style"], " / ", x["n"]["style"]), "请统一同一层级的标题编号样式"))
            parent = F.get(F.reverse(x["above"]), F.lit(0))
            orphan = given(F.coalesce((x["n"]["style"] == "decimal") & (parent != F.get(F.reverse(x["n"]["numbers"]), F.lit(1))), F.lit(False)), issue(x, texts("标题编号父级不匹配：", prefix), "请使小节编号与当前上级标题编号一致"))
            previous = last(F.filter(before(xs, i), lambda y: (y["n"]["level"] == level) & (context(y) == context(x))))["number"]
            gap = let(previous, lambda n: given(F.coalesce(x["number"] != n + 1, F.lit(False)), issue(x, texts("标题编号不连续：", n, " 后出现 ", prefix), texts("请将本级编号调整为 ", n + 1))))
            return F.concat(jump, style, orphan, gap)

        return F.flatten(F.transform(xs, faults))

    def judged(xs: Column) -> Column:
        later = let(let(F.filter(xs, lambda x: x["n"].isNotNull()), with_context), second_phase)
        return F.slice(F.concat(none(), F.flatten(F.transform(xs, first_phase)), later), 1, most)

    return let(named, judged)


@operator("reference_format")
def reference_format(rule: Rule) -> Column:
    """Entries of the references without a year or a type. An entry is placed at the first block that holds its beginning."""
    heads = F.transform(BLOCKS(), lambda b: (b["type"] == "heading") & has(b["text"], "参考文献"))
    start = F.array_position(heads, True).cast("int")

    def section(s: Column) -> Column:
        rest = F.slice(BLOCKS(), s + 1, F.size(BLOCKS()))
        stop = F.array_position(F.transform(rest, lambda b: (b["type"] == "heading") & (b["level"] == 1)), True).cast("int")
        own = F.when(stop > 0, F.slice(rest, F.lit(1), stop - 1)).otherwise(rest)
        lines = F.flatten(F.transform(own, lambda b: F.transform(F.split(b["text"], r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"), lambda t: strip(t))))
        return F.when(s > 0, F.array_join(F.filter(lines, lambda t: t != ""), "\n")).otherwise("")

    bracket, loose = r"(?U)(?<![^\n])(?=\[\d+\])", r"(?U)(?<![^\n])(?=[（(]?\d+[）).、])"

    def entries(text: Column) -> Column:
        by_bracket = F.filter(F.split(text, bracket), lambda e: F.regexp_like(e, F.lit(r"(?U)\A\[\d+\]")))
        return let(by_bracket, lambda found: of_entries(text, found))

    def of_entries(text: Column, by_bracket: Column) -> Column:
        parts = F.transform(F.split(text, loose), lambda e: F.struct(e.alias("e"), formats.ascii_digits(F.regexp_extract(e, r"(?U)\A[（(]?(\d+)[）).、]", 1)).try_cast("int").alias("n")))
        # numbers count while they rise within 1..200; a part whose number doesn't count goes on with the one before
        state = F.array().cast("array<struct<e:string,n:int>>")

        def step(acc: Column, x: Column) -> Column:
            top = F.coalesce(F.get(F.reverse(acc), F.lit(0))["n"], F.lit(0))
            longer = F.struct(F.concat(F.get(F.reverse(acc), F.lit(0))["e"], x["e"]).alias("e"), F.get(F.reverse(acc), F.lit(0))["n"].alias("n"))
            return F.when(F.coalesce((x["n"] >= 1) & (x["n"] <= 200) & (x["n"] > top), F.lit(False)), F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(acc)

        by_number = F.transform(F.aggregate(parts, state, step), lambda x: x["e"])
        return F.slice(F.filter(F.transform(F.when(F.size(by_bracket) > 0, by_bracket).otherwise(by_number), lambda e: strip(e)), lambda e: e != ""), 1, 100)

    def bare(t: Column) -> Column:
        return F.translate(t, WHITE, "")

    def fault(e: Column, bodies: Column) -> Column:
        missing = F.array_compact(F.array(F.when(~F.regexp_like(e, F.lit(r"(?U)(?:19|20)\d{2}")), "出版年份"), F.when(~F.regexp_like(e, F.lit(r"(?i)\[[JMCDBRNSP]\]")), "文献类型标识")))
        at = let(bare(F.substring(e, 1, 120)), lambda head: F.array_position(F.transform(bodies, lambda t: F.coalesce(F.contains(t, head), F.lit(False))), True).cast("int"))
        told = lambda m, place: finding(rule, texts("参考文献条目缺少：", F.array_join(m, "、")), "请按 GB/T 7714 补全著者、题名、类型、出处和年份", page=place["page"], block=place["id"], evidence=e)
        return let(missing, lambda m: F.when(F.size(m) > 0, let(F.get(BLOCKS(), at - 1), lambda place: F.array(told(m, place)))).otherwise(none()))

    every = let(let(start, section), entries)
    return joined(let(F.transform(BLOCKS(), lambda b: bare(b["text"])), lambda bodies: F.flatten(F.transform(every, of(lambda e: fault(e, bodies))))))


#: Full-width forms and the ASCII characters that compatibility normalisation makes of them.
MODES = ("text", "casefold", "number", "date", "phone", "list")


def normalised(value: Column, kind: str) -> Column:
    """struct<key, number, error> of a field's value, whose compatibility characters have given way to their plain forms."""
    if kind not in MODES:
        raise RuleError(f"unknown normalisation {kind!r}")
    return let(strip(compatible(value)), lambda v: _normalised(v, value, kind))


def _normalised(v: Column, value: Column, kind: str) -> Column:
    key, number, error = F.lit(None).cast("string"), F.lit(None).cast("decimal(38,8)"), F.lit(None).cast("string")
    if kind == "number":
        read = lambda plain: F.when(whole(plain, r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"), plain.try_cast("decimal(28,8)"))
        times = lambda compact: F.when(F.endswith(compact, F.lit("万")), F.lit(10000)).otherwise(F.lit(1))
        amount = lambda compact: (let(F.regexp_replace(compact, r"万\z", ""), read) * times(compact)).cast("decimal(38,8)")
        unread = lambda n: F.when(n.isNull(), texts("无法识别数字“", value, "”"))
        found = let(F.translate(v, ",，￥¥元" + WHITE, ""), amount)
        return let(found, lambda n: F.struct(key.alias("key"), n.alias("number"), unread(n).alias("error")))
    elif kind == "date":
        p = r"(?U)\A(\d{4})\s*(?:年|[-/.])\s*(\d{1,2})\s*(?:月|[-/.])\s*(\d{1,2})\s*日?\z"
        part = lambda i: F.regexp_extract(v, p, i)
        real = formats.real_date(part(1), part(2), part(3))
        key = F.when(real, F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
        error = F.when(~F.regexp_like(v, F.lit(p)), texts("无法识别日期“", value, "”")).when(~real, texts("日期无效“", value, "”"))
    elif kind == "phone":
        digits = F.regexp_replace(v, r"(?U)\D", "")
        key = F.when((F.length(digits) == 13) & F.startswith(digits, F.lit("86")), F.substring(digits, 3, 11)).otherwise(digits)
    elif kind == "list":
        key = F.array_join(F.array_sort(F.transform(F.filter(F.split(v, r"(?U)[、,，;；/\s]+"), lambda x: x != ""), of(casefolded))), "\x1f")
    else:
        bare = F.regexp_replace(F.regexp_replace(v, r"(?U)[\s　]+", ""), "[，,。；;：:‘’“”\"']+\\z", "")
        key = casefolded(bare) if kind == "casefold" else bare
    return F.struct(key.alias("key"), number.alias("number"), error.alias("error"))


def agreeing(values: Column, kind: str, tolerance) -> Column:
    """Whether normalised values, all readable, are the same: numbers within the tolerance, others exactly."""
    if kind == "number":
        numbers = F.transform(values, lambda x: x["number"])
        return F.array_max(numbers) - F.array_min(numbers) <= F.lit(str(tolerance)).cast("decimal(38,8)")
    return F.size(F.array_distinct(F.transform(values, lambda x: x["key"]))) <= 1


def occurrences(field: dict) -> Column:
    """A field's values that aren't empty, with those that its pattern finds: the group `value`, or the first, or the whole."""
    labelled = F.filter(field_matches(field), lambda m: ~is_empty(m["value"]))
    pattern = str(field.get("pattern", "")).strip()
    if not pattern:
        return labelled
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise RuleError(f"bad pattern of field {field.get('name', '')}: {e}") from e
    group = compiled.groupindex.get("value", 1 if compiled.groups else 0)
    p = F.lit(java(pattern))
    pairs = lambda b: F.arrays_zip(F.regexp_extract_all(b["text"], p, F.lit(0)).alias("e"), F.regexp_extract_all(b["text"], p, F.lit(group)).alias("v"))
    by_pattern = F.flatten(F.transform(BLOCKS(), lambda b: F.transform(pairs(b), lambda x: F.struct(strip(x["v"]).alias("value"), b["page"].alias("page"), b["id"].alias("id"), F.substring(x["e"], 1, 200).alias("evidence")))))
    same = lambda a, b: (a["value"] == b["value"]) & a["page"].eqNullSafe(b["page"]) & a["id"].eqNullSafe(b["id"])
    return let(F.concat(labelled, by_pattern), lambda ms: F.filter(ms, lambda m, i: ~F.exists(F.slice(ms, F.lit(1), i), lambda x: same(x, m))))


@operator("cross_field_consistency")
def cross_field_consistency(rule: Rule) -> Column:
    fields, comparisons = rule.params.get("fields", []), rule.params.get("comparisons", [])
    if not isinstance(fields, list) or not isinstance(comparisons, list) or any(not isinstance(x, dict) for x in [*fields, *comparisons]):
        raise RuleError(f"{rule.id}: fields and comparisons must be lists of mappings")
    out, named = [], {}
    for field in fields:
        name, kind, tolerance = field_names(field)[0], str(field.get("normalize", "text")), field.get("tolerance", 0)
        named[name], least, check = occurrences(field), max(2, int(field.get("min_occurrences", 2))), str(field.get("validation_pattern", "")).strip()
        re.compile(check)

        def judged(ms: Column, name=name, kind=kind, tolerance=tolerance, least=least, check=check) -> Column:
            at = {"page": first(ms)["page"], "block": first(ms)["id"]}
            wrong = none()
            if check:
                bad = first(F.filter(ms, lambda m: ~whole(m["value"], check)))
                wrong = let(bad, lambda m: given(m.isNotNull(), finding(rule, texts(f"「{name}」格式不符合规则：", m["value"]), f"请检查{name}格式和长度", page=m["page"], block=m["id"], evidence=m["evidence"])))

            def compared(vs: Column) -> Column:
                error = first(F.filter(F.transform(vs, lambda v: v["error"]), lambda e: e.isNotNull()))
                unread = finding(rule, texts(f"「{name}」无法进行一致性比较：", error), f"请检查{name}的填写格式", evidence=first(ms)["evidence"], **at)
                shown = F.array_join(F.slice(F.array_distinct(F.transform(ms, lambda m: m["value"])), 1, 4), " / ")
                differ = finding(rule, texts(f"「{name}」在多处取值不一致：", shown), "请统一封面、正文、表格和附件中的字段取值", evidence=F.array_join(F.transform(F.slice(ms, 1, 3), lambda m: m["evidence"]), "；"), **at)
                return F.when(F.size(ms) < least, none()).when(error.isNotNull(), F.array(unread)).when(agreeing(vs, kind, tolerance), none()).otherwise(F.array(differ))

            return F.concat(wrong, let(F.transform(ms, lambda m: normalised(m["value"], kind)), compared))

        out.append(let(named[name], judged))
    for comparison in comparisons:
        sides = []
        for side in (comparison.get("left"), comparison.get("right")):
            if isinstance(side, str):
                sides.append((side, named.get(side)))
            elif isinstance(side, dict):
                sides.append((field_names(side)[0], occurrences(side)))
            else:
                raise RuleError(f"{rule.id}: a comparison's side is a field's name or a mapping")
        (left_name, left), (right_name, right) = sides
        if left is None or right is None:
            continue
        kind, tolerance, hint = str(comparison.get("normalize", "text")), comparison.get("tolerance", 0), str(comparison.get("suggestion", "请核对并统一关联字段"))
        both = F.struct(left.alias("l"), right.alias("r"))

        def paired(s: Column, left_name=left_name, right_name=right_name, kind=kind, tolerance=tolerance, hint=hint) -> Column:
            def met(n: Column) -> Column:
                fine = lambda x: x["error"].isNull()
                any_pair = lambda f: F.exists(n["l"], lambda a: F.exists(n["r"], lambda b: fine(a) & fine(b) & f(a, b)))
                at = {"page": first(s["r"])["page"], "block": first(s["r"])["id"], "evidence": texts(first(s["l"])["evidence"], "；", first(s["r"])["evidence"])}
                unread = finding(rule, texts("字段间无法进行一致性比较：", F.coalesce(first(n["l"])["error"], first(n["r"])["error"])), "请检查关联字段的填写格式", **at)
                differ = finding(rule, texts(f"字段间取值不一致：「{left_name}」为 ", first(s["l"])["value"], f"，「{right_name}」为 ", first(s["r"])["value"]), hint, **at)
                agrees = any_pair(lambda a, b: agreeing(F.array(a, b), kind, tolerance))
                comparable = any_pair(lambda a, b: F.lit(True))
                return F.when((F.size(s["l"]) == 0) | (F.size(s["r"]) == 0) | agrees, none()).when(comparable, F.array(differ)).otherwise(F.array(unread))

            values = lambda ms: F.transform(ms, lambda m: normalised(m["value"], kind))
            return let(F.struct(values(s["l"]).alias("l"), values(s["r"]).alias("r")), met)

        out.append(let(both, paired))
    return joined(*out)


#: Page sizes in points.
PAGE_SIZES = {"A4": (595.28, 841.89), "A3": (841.89, 1190.55), "LETTER": (612.0, 792.0)}
SIDES = {"left": "左", "right": "右", "top": "上", "bottom": "下"}


def config_of(rule: Rule, name: str) -> dict:
    found = rule.params.get(name) or {}
    if not isinstance(found, dict):
        raise RuleError(f"{rule.id}: {name} must be a mapping")
    return found


def shown_list(numbers: Column) -> Column:
    return texts("[", F.array_join(numbers.cast("array<string>"), ", "), "]")


def page_layout(rule: Rule) -> Column:
    config = config_of(rule, "page")
    if not config:
        return none()
    name, way, tolerance = str(config.get("size", "A4")).upper(), str(config.get("orientation", "portrait")), float(config.get("tolerance_pt", 12))
    if name not in PAGE_SIZES or way not in ("portrait", "landscape", "any"):
        raise RuleError(f"{rule.id}: unknown page size {name} or orientation {way}")
    w, h = PAGE_SIZES[name]
    near = lambda m, a, b: (F.abs(m["width"] - a) <= tolerance) & (F.abs(m["height"] - b) <= tolerance)
    fits = {"portrait": lambda m: near(m, w, h), "landscape": lambda m: near(m, h, w), "any": lambda m: near(m, w, h) | near(m, h, w)}[way]
    wrong = F.transform(F.filter(META(), lambda m: ~fits(m)), lambda m: m["page_number"])
    return let(wrong, lambda p: given(F.size(p) > 0, finding(rule, texts(f"页面尺寸或方向不符合 {name} {way} 要求：第", shown_list(p), "页"), f"请将页面设置为 {name}，方向为 {way}", page=F.get(p, F.lit(0)))))


def margin_layout(rule: Rule) -> Column:
    config = config_of(rule, "margins_mm")
    excluded, out = [int(x) for x in config.get("exclude_pages", [])], []
    for side, label in SIDES.items():
        least = float(config.get(f"{side}_min", 0)) * 72 / 25.4
        if least <= 0:
            continue

        def measured(m: Column, side=side) -> Column:
            body = F.filter(BLOCKS(), lambda b: (b["page"] == m["page_number"]) & b["type"].isin("heading", "paragraph", "table", "list") & (strip(b["text"]) != "") & (b["bbox"]["x1"] > b["bbox"]["x0"]) & (b["bbox"]["y1"] > b["bbox"]["y0"]))
            edge = lambda f: F.transform(body, lambda b: b["bbox"][f])
            return {"left": F.array_min(edge("x0")), "right": m["width"] - F.array_max(edge("x1")), "top": F.array_min(edge("y0")), "bottom": m["height"] - F.array_max(edge("y1"))}[side]

        narrow = F.transform(F.filter(META(), of(lambda m, measured=measured, least=least: ~m["page_number"].isin(*excluded) & F.coalesce(measured(m) + 1 < least, F.lit(False)))), lambda m: m["page_number"])
        told = lambda p, side=side, label=label: given(F.size(p) > 0, finding(rule, texts("第", shown_list(p), f"页{label}边距小于 {config[f'{side}_min']}mm"), f"请将{label}边距调整到要求值以上", page=F.get(p, F.lit(0))))
        out.append(let(narrow, told))
    return joined(*out)


def body_layout(rule: Rule) -> Column:
    config = config_of(rule, "body")
    if not config:
        return none()
    body = F.filter(BLOCKS(), lambda b: (b["type"] == "paragraph") & ~F.coalesce(F.array_contains("ocr_pages", b["page"]), F.lit(False)) & (b["font"]["size"] > 0))
    least, most, way = config.get("min_size"), config.get("max_size"), str(config.get("alignment", ""))
    size = mode(F.transform(body, lambda b: F.bround(b["font"]["size"], 1)))
    out = []
    if least is not None:
        out.append(let(size, lambda s: given(F.coalesce(s < float(least), F.lit(False)), finding(rule, texts("正文主字号 ", s, f"pt 小于要求 {least}pt"), "请调整正文主字号"))))
    if most is not None:
        out.append(let(size, lambda s: given(F.coalesce(s > float(most), F.lit(False)), finding(rule, texts("正文主字号 ", s, f"pt 大于要求 {most}pt"), "请调整正文主字号"))))
    told = lambda wrong, message, hint: let(wrong, lambda w: given(F.size(w) > 0, finding(rule, texts("检测到 ", F.size(w), message), hint, page=first(w)["page"], block=first(w)["id"], evidence=first(w)["text"])))
    if way:
        wrong = F.filter(body, lambda b: (F.coalesce(b["layout"]["alignment"], F.lit("")) != "") & (b["layout"]["alignment"] != way))
        out.append(told(wrong, f" 个正文段落未按 {way} 对齐", f"请将正文对齐方式统一为 {way}"))
    for metric, label in (("line_spacing_pt", "行距"), ("first_line_indent_pt", "首行缩进")):
        exact, low, high = config.get(metric), config.get(metric.replace("_pt", "_min_pt")), config.get(metric.replace("_pt", "_max_pt"))
        if exact is None and low is None and high is None:
            continue
        slack = float(config.get(f"{metric}_tolerance", 2))

        def off(b: Column, metric=metric, exact=exact, low=low, high=high, slack=slack) -> Column:
            v, bad = b["layout"][metric], F.lit(False)
            bad = bad | (F.abs(v - float(exact)) > slack) if exact is not None else bad
            bad = bad | (v < float(low) - slack) if low is not None else bad
            bad = bad | (v > float(high) + slack) if high is not None else bad
            return F.coalesce((b["layout"]["line_count"] >= 2) & bad, F.lit(False))

        out.append(told(F.filter(body, of(off)), f" 个正文段落的{label}不符合配置要求", f"请统一正文{label}"))
    return joined(*out)


def heading_layout(rule: Rule) -> Column:
    configs = config_of(rule, "headings")
    if any(c and not isinstance(c, dict) for c in configs.values()):
        raise RuleError(f"{rule.id}: a heading's style must be a mapping")

    def problems(h: Column, c: dict) -> Column:
        size, found = h["font"]["size"], []
        if font := str(c.get("font", "")):
            found.append(F.when(~F.contains(font_name(h["font"]["name"]), F.lit(font)), texts("字体为", F.coalesce(F.nullif(h["font"]["name"], F.lit("")), F.lit("未知")), f"，要求{font}")))
        if c.get("size") is not None:
            found.append(F.when(F.abs(size - float(c["size"])) > float(c.get("size_tolerance", 0.5)), texts("字号为", size, f"pt，要求{c['size']}pt")))
        if c.get("min_size") is not None:
            found.append(F.when(size < float(c["min_size"]), texts("字号", size, "pt过小")))
        if c.get("max_size") is not None:
            found.append(F.when(size > float(c["max_size"]), texts("字号", size, "pt过大")))
        if c.get("bold") is True:
            found.append(F.when(~F.coalesce(h["font"]["bold"], F.lit(False)), F.lit("未加粗")))
        if way := str(c.get("alignment", "")):
            found.append(F.when(~h["layout"]["alignment"].eqNullSafe(F.lit(way)), F.lit(f"未按{way}对齐")))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def judged(h: Column) -> Column:
        own = F.array().cast("array<string>")
        for level, c in configs.items():
            if c:
                own = F.when(h["level"] == int(level), problems(h, c)).otherwise(own)
        return let(own, lambda p: given(F.size(p) > 0, finding(rule, texts("第", h["level"], "级标题版式不符合要求：", F.array_join(p, "；")), "请按指南统一该级标题版式", page=h["page"], block=h["id"], evidence=h["text"])))

    return joined(F.flatten(F.transform(headings(), judged))) if configs else none()


@operator("layout_check")
def layout_check(rule: Rule) -> Column:
    found = joined(page_layout(rule), margin_layout(rule), body_layout(rule), heading_layout(rule))
    return F.slice(found, 1, max(1, int(rule.params.get("max_issues", 30))))
