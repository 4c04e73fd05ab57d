"""The rule operators over documents with planted faults, each with SQL over the documents' blocks.

A document is an order, and each of its lines one block, whose text and form the line's part and supplier decide; so faults are
frequent, and every rule both fires and doesn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans import ir, review, rules
from foliant.plans.driver_queries import query, table

#: x holds i (from 1), pk, sk and price of a line; every query's SQL reads l.
LINES = "WITH l AS (SELECT l_orderkey::VARCHAR AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_partkey AS pk, l_suppkey AS sk, floor(l_extendedprice)::BIGINT AS price FROM lineitem),\n"

Make = Callable[[Column, Column], Column]


def order_documents(spark: SparkSession, sf_dir: str, make: Make, before: list[Column] = (), meta: Make | None = None, blocks: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row for each order. make(x, i): the block of line x at place i; before: blocks that come first; meta: the page of line
    x; blocks: all blocks of the lines at once, instead of make."""
    line = F.struct("l_linenumber", F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.floor("l_extendedprice").cast("long").alias("price"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("x"))
    own = blocks(F.col("x")) if blocks else F.transform("x", lambda x, i: make(x, i + len(before)))
    every = F.concat(F.array(*before), own) if before else own
    page = meta or (lambda x, i: F.struct(i + 1, F.lit(595.0), F.lit(842.0), F.lit("ok"), F.lit(0), F.lit(""), F.lit(0.0), F.lit(False)))
    total = F.aggregate(every, F.lit(0).cast("long"), lambda a, b: a + b["words"])
    empty = lambda t: F.array().cast(t)
    ident = F.col("l_orderkey").cast("string")
    return orders.select(
        ident.alias("doc_id"), ident.alias("filename"), F.size("x").alias("pages"), total.alias("word_count"), empty("array<int>").alias("ocr_pages"), empty("array<string>").alias("parse_warnings"),
        F.transform("x", lambda x, i: page(x, i)).cast(f"array<{ir.PAGE}>").alias("page_meta"), every.alias("blocks"),
    )


def found(documents: DataFrame, rule: str) -> DataFrame:
    return review.findings(documents, rules.load(f"id: planted\nname: planted\nrules:\n- {rule}")).select("doc_id", "message")


def pick(c: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def sql_pick(c: str, *values: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][{c} % {len(values)} + 1]"


SECTIONS = ("立项依据", "研究内容", "研究方案", "研究基础")


@query("rule_section_order", LINES + f"""
h AS (SELECT doc_id, list_position({list(SECTIONS)!r}, {sql_pick("pk", *SECTIONS)}) AS e, min(i) AS pos FROM l WHERE sk % 3 > 0 GROUP BY ALL),
d AS (SELECT *, lag(e) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM h),
f AS (SELECT doc_id, arg_min(e, pos) AS e FROM d WHERE e < prior GROUP BY doc_id)
SELECT doc_id, '章节顺序不符合预期：「' || {list(SECTIONS)!r}[e] || '」应在第' || e || '位' AS message FROM f""")
def rule_section_order(spark, sf_dir):
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "heading", pick(x["pk"], *SECTIONS), F.when(x["sk"] % 3 > 0, 1).otherwise(2), i + 1))
    return found(docs, f"{{id: K2, type: section_order, params: {{expected_order: [{', '.join(SECTIONS)}]}}}}")


@query("rule_page_limit", LINES + f"""
p AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
h AS (SELECT doc_id, min(i) AS pos FROM l WHERE {sql_pick("pk", *SECTIONS)} = '研究内容' GROUP BY doc_id),
e AS (SELECT h.doc_id, pos, min(l.i) AS later FROM h LEFT JOIN l ON l.doc_id = h.doc_id AND l.i > pos AND sk % 3 > 0 GROUP BY ALL),
s AS (SELECT e.doc_id, coalesce(later - 1, n) - pos + 1 AS size FROM e JOIN p USING (doc_id))
SELECT doc_id, '总页数超出限制（' || n || '页 > 5页）' AS message FROM p WHERE n > 5
UNION ALL SELECT doc_id, '章节「研究内容」页数超限（' || size || '页 > 1页）' FROM s WHERE size > 1""")
def rule_page_limit(spark, sf_dir):
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "heading", pick(x["pk"], *SECTIONS), F.when(x["sk"] % 3 > 0, 1).otherwise(2), i + 1))
    return found(docs, "{id: K3, type: page_limit, params: {max_pages: 5, section_limits: {研究内容: 1}}}")


FONT_NAMES, SIZES = ("SimSun", "SimHei", "KaiTi"), (10.5, 11.0, 12.0)


@query("rule_font_check", LINES + f"""
n AS (SELECT doc_id, {sql_pick("sk", *FONT_NAMES)} AS v, count(*) AS c, min(i) AS pos FROM l GROUP BY ALL),
z AS (SELECT doc_id, {list(SIZES)!r}[pk % 3 + 1] AS v, count(*) AS c, min(i) AS pos FROM l GROUP BY ALL),
nm AS (SELECT doc_id, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, pos) AS r FROM n) WHERE r = 1),
zm AS (SELECT doc_id, v FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, pos) AS r FROM z) WHERE r = 1)
SELECT doc_id, '正文字体不符合要求（检测为' || v || '，要求宋体）' AS message FROM nm WHERE v <> 'SimSun'
UNION ALL SELECT doc_id, '正文字号不符合要求（检测为' || v || 'pt，要求12pt）' FROM zm WHERE abs(v - 12) > 0.5""")
def rule_font_check(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        size = F.element_at(F.array(*map(F.lit, SIZES)), (x["pk"] % 3 + 1).cast("int"))
        return ir.block(i, "paragraph", F.lit("正文"), 0, i + 1).withField("font.name", pick(x["sk"], *FONT_NAMES)).withField("font.size", size)

    return found(order_documents(spark, sf_dir, make), "{id: K5, type: font_check, params: {body_font: 宋体, body_size: 12}}")


@query("rule_page_number_check", LINES + """
s AS (SELECT doc_id, i, CASE WHEN pk % 4 = 0 THEN NULL WHEN sk % 5 = 0 THEN i + 1 ELSE i END AS n FROM l),
seen AS (SELECT doc_id, count(*) AS pages, count(n) AS shown FROM s GROUP BY doc_id),
lost AS (SELECT doc_id, string_agg(i::VARCHAR, ', ' ORDER BY i) AS a FROM s WHERE i > 1 AND n IS NULL GROUP BY doc_id),
row_ AS (SELECT doc_id, string_agg(n::VARCHAR, ', ' ORDER BY i) AS a, bool_or(n <> prior + 1) AS broken FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM s WHERE i > 1 AND n IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, '未检测到可验证的页脚页码' AS message FROM seen WHERE pages > 1 AND shown = 0
UNION ALL SELECT doc_id, '以下页面未检测到页码：[' || a || ']' FROM lost JOIN seen USING (doc_id) WHERE shown > 0
UNION ALL SELECT doc_id, '页码不连续：[' || a || ']' FROM row_ WHERE broken""")
def rule_page_number_check(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        text = F.when(x["pk"] % 4 == 0, "无").otherwise(F.concat(F.lit("- "), F.when(x["sk"] % 5 == 0, i + 2).otherwise(i + 1).cast("string"), F.lit(" -")))
        return ir.block(i, "paragraph", text, 0, i + 1).withField("bbox.y0", F.lit(800.0))

    return found(order_documents(spark, sf_dir, make), "{id: K6, type: page_number_check, params: {allow_unnumbered_front_pages: 1}}")


@query("rule_numbering", LINES + """
k AS (SELECT doc_id, CASE WHEN pk % 3 < 2 THEN '图' ELSE '表' END AS label, (sk % 5 + 1)::INT AS n, pk % 3 = 0 AS caption FROM l),
g AS (SELECT doc_id, label, list_sort(list(DISTINCT n)) AS ns FROM k GROUP BY ALL),
m AS (SELECT doc_id, label, list_filter(range(1, ns[-1] + 1), lambda x: NOT list_contains(ns, x)) AS m FROM g),
c AS (SELECT doc_id, list(DISTINCT n) AS cs FROM k WHERE caption GROUP BY doc_id),
b AS (SELECT g.doc_id, list_filter(ns, lambda x: NOT list_contains(cs, x)) AS m FROM g JOIN c USING (doc_id) WHERE label = '图')
SELECT doc_id, label || '编号不连续，缺少：' || array_to_string(list_transform(m, lambda x: label || x), '、') AS message FROM m WHERE len(m) > 0
UNION ALL SELECT doc_id, '图题注缺失：' || array_to_string(list_transform(m, lambda x: '图' || x), '、') FROM b WHERE len(m) > 0""")
def rule_numbering(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        n = (x["sk"] % 5 + 1).cast("string")
        text = F.when(x["pk"] % 3 == 0, F.concat(F.lit("图"), n, F.lit(" 结构"))).when(x["pk"] % 3 == 1, F.concat(F.lit("如图"), n, F.lit("所示"))).otherwise(F.concat(F.lit("见表"), n))
        return ir.block(i, "paragraph", text, 0, i + 1)

    return found(order_documents(spark, sf_dir, make), "{id: K7, type: figure_table_numbering}")


ITEMS = ("设备费", "材料费", "劳务费")


@query("rule_budget_check", LINES + f"""
r AS (SELECT doc_id, i, {sql_pick("pk", *ITEMS)} AS item, price, sum(price) OVER (PARTITION BY doc_id)::BIGINT AS detail, (sum(price) OVER (PARTITION BY doc_id) + doc_id::BIGINT % 3)::BIGINT AS total FROM l)
SELECT doc_id, '预算勾稽不平：分项合计 ' || any_value(detail) || '.0 ≠ 总额 ' || any_value(total) || '.0' AS message FROM r GROUP BY doc_id HAVING any_value(detail) <> any_value(total)
UNION ALL SELECT doc_id, '「设备费」占比超过上限 30%' FROM r WHERE item = '设备费' AND price * 10 > total * 3""")
def rule_budget_check(spark, sf_dir):
    def one(x: Column) -> Column:
        row = lambda a, b: F.array(a, b)
        total = F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y["price"]) + F.col("l_orderkey") % 3
        rows = F.concat(F.array(row(F.lit("科目"), F.lit("金额（元）"))), F.transform(x, lambda y: row(pick(y["pk"], *ITEMS), y["price"].cast("string"))), F.array(row(F.lit("合计"), total.cast("string"))))
        return F.array(ir.block(F.lit(0), "table", F.lit("预算")).withField("table_data", rows))

    # the share itself is left out of the message, as engines round it by different rules
    out = found(order_documents(spark, sf_dir, None, blocks=one), "{id: K8, type: budget_check, params: {max_ratio: {设备费: 0.3}}}")
    return out.select("doc_id", F.regexp_replace("message", r"占比 [0-9.]+% ", "占比").alias("message"))


@query("rule_date_check", LINES + """
t AS (SELECT doc_id, i, 2020 + pk % 4 AS y1, sk % 12 + 1 AS m1, 2021 + sk % 4 AS y2, pk % 12 + 1 AS m2 FROM l WHERE pk % 3 = 0),
bad AS (SELECT doc_id, arg_min(y1, i) AS y, arg_min(m1, i) AS m FROM t WHERE (y1, m1) >= (y2, m2) GROUP BY doc_id),
every AS (SELECT doc_id, y1 * 12 + m1 AS m FROM t UNION ALL SELECT doc_id, y2 * 12 + m2 FROM t),
n AS (SELECT doc_id, max(m) - min(m) + 1 AS n FROM every GROUP BY doc_id)
SELECT doc_id, '研究期限日期异常：开始日期 ' || y || '年' || m || '月 不早于结束日期' AS message FROM bad
UNION ALL SELECT doc_id, '研究期限 ' || n || ' 个月，与指南要求的 24 个月不一致' FROM n WHERE n <> 24""")
def rule_date_check(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        s = lambda c: c.cast("string")
        text = F.concat(F.lit("研究期限："), s(2020 + x["pk"] % 4), F.lit("年"), s(x["sk"] % 12 + 1), F.lit("月至"), s(2021 + x["sk"] % 4), F.lit("年"), s(x["pk"] % 12 + 1), F.lit("月"))
        return ir.block(i, "paragraph", F.when(x["pk"] % 3 == 0, text).otherwise("正文"), 0, i + 1)

    return found(order_documents(spark, sf_dir, make), "{id: K9, type: date_check, params: {expected_months: 24}}")


@query("rule_cross_field", LINES + """
v AS (SELECT doc_id, 'P' || pk % 3 AS v, min(i) AS pos, count(*) AS c FROM l WHERE sk % 2 = 0 GROUP BY ALL)
SELECT doc_id, '「项目编号」在多处取值不一致：' || string_agg(v, ' / ' ORDER BY pos) AS message FROM v GROUP BY doc_id HAVING count(*) > 1""")
def rule_cross_field(spark, sf_dir):
    text = lambda x: F.when(x["sk"] % 2 == 0, F.concat(F.lit("项目编号："), F.lit("P"), (x["pk"] % 3).cast("string"))).otherwise("正文")
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "paragraph", text(x), 0, i + 1))
    return found(docs, "{id: K12, type: cross_field_consistency, params: {fields: [{name: 项目编号}]}}")


@query("rule_field_format", LINES + """
v AS (SELECT doc_id, CASE WHEN sk % 3 = 0 THEN '12' || pk ELSE '1380000' || lpad((pk % 10000)::VARCHAR, 4, '0') END AS v FROM l WHERE pk % 2 = 0)
SELECT doc_id, '字段「手机」格式不正确：' || v AS message FROM v WHERE NOT regexp_full_match(v, '1[3-9][0-9]{9}')""")
def rule_field_format(spark, sf_dir):
    number = lambda x: F.when(x["sk"] % 3 == 0, F.concat(F.lit("12"), x["pk"].cast("string"))).otherwise(F.concat(F.lit("1380000"), F.lpad((x["pk"] % 10000).cast("string"), 4, "0")))
    text = lambda x: F.when(x["pk"] % 2 == 0, F.concat(F.lit("手机："), number(x))).otherwise("正文")
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "paragraph", text(x), 0, i + 1))
    return found(docs, "{id: K14, type: field_format, params: {fields: [{name: 手机, format: cn_mobile}]}}")


@query("rule_heading_numbering", LINES + """
h AS (SELECT doc_id, i, sk % 3 + 1 AS n, lag(sk % 3 + 1) OVER (PARTITION BY doc_id ORDER BY i) AS prior FROM l WHERE pk % 4 > 0)
SELECT doc_id, '标题编号不连续：' || prior || ' 后出现 ' || n || '.' AS message FROM h WHERE n <> prior + 1""")
def rule_heading_numbering(spark, sf_dir):
    text = lambda x: F.concat((x["sk"] % 3 + 1).cast("string"), F.lit(". 标题"))
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, F.when(x["pk"] % 4 > 0, "heading").otherwise("paragraph"), text(x), 1, i + 2))
    return found(docs, "{id: K15, type: heading_numbering}")


@query("rule_layout_check", LINES + """
p AS (SELECT doc_id, string_agg(i::VARCHAR, ', ' ORDER BY i) AS a FROM l WHERE sk % 4 = 0 GROUP BY doc_id),
b AS (SELECT doc_id, count(*) AS n FROM l WHERE pk % 3 = 0 GROUP BY doc_id)
SELECT doc_id, '页面尺寸或方向不符合 A4 portrait 要求：第[' || a || ']页' AS message FROM p
UNION ALL SELECT doc_id, '检测到 ' || n || ' 个正文段落未按 left 对齐' FROM b""")
def rule_layout_check(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        layout = F.struct(F.when(x["pk"] % 3 == 0, "center").otherwise("left").alias("alignment"), F.lit(1).alias("line_count"), *[F.lit(None).cast("double").alias(c) for c in ("line_spacing_pt", "line_spacing_multiple", "first_line_indent_pt", "left_indent_pt", "right_indent_pt", "space_before_pt", "space_after_pt")])
        return ir.block(i, "paragraph", F.lit("正文"), 0, i + 1).withField("font.size", F.lit(12.0)).withField("layout", layout)

    page = lambda x, i: F.struct(i + 1, F.when(x["sk"] % 4 == 0, 842.0).otherwise(595.0), F.when(x["sk"] % 4 == 0, 595.0).otherwise(842.0), F.lit("ok"), F.lit(0), F.lit(""), F.lit(0.0), F.lit(False))
    return found(order_documents(spark, sf_dir, make, meta=page), "{id: K16, type: layout_check, params: {page: {size: A4}, body: {alignment: left}}}")


@query("rule_reference_format", LINES + """
e AS (SELECT doc_id, pk % 2 = 0 AS kind, sk % 3 = 0 AS dated FROM l)
SELECT doc_id, '参考文献条目缺少：' || concat_ws('、', CASE WHEN NOT dated THEN '出版年份' END, CASE WHEN NOT kind THEN '文献类型标识' END) AS message FROM e WHERE NOT (kind AND dated)""")
def rule_reference_format(spark, sf_dir):
    def make(x: Column, i: Column) -> Column:
        text = F.concat(F.lit("["), i.cast("string"), F.lit("] Author. Title"), F.when(x["pk"] % 2 == 0, "[J]").otherwise(""), F.when(x["sk"] % 3 == 0, ", 2019").otherwise(""))
        return ir.block(i, "paragraph", text, 0, 2)

    docs = order_documents(spark, sf_dir, make, before=[ir.block(F.lit(0), "heading", F.lit("参考文献"), 1, 1)])
    return found(docs, "{id: K20, type: reference_format}")


@query("review_incomplete", LINES + """
d AS (SELECT doc_id, count(*) AS n, bool_or(pk % 3 = 0) AS there, bool_or(sk % 5 = 0) AS unread, bool_or(sk % 7 = 1) AS hidden, count(*) FILTER (sk % 7 = 1 AND sk % 5 > 0) AS hid FROM l GROUP BY doc_id)
SELECT doc_id, (1 + hid)::BIGINT AS total_issues, CASE WHEN there OR unread OR hid > 0 THEN 0 ELSE 1 END::BIGINT AS errors, (CASE WHEN there OR unread OR hid > 0 THEN 1 ELSE 0 END + hid)::BIGINT AS manual_required_checks, 1::BIGINT AS skipped_checks,
  FALSE AS ai_complete, FALSE AS review_complete, 'incomplete' AS conclusion FROM d""")
def review_incomplete(spark, sf_dir):
    """Pages that weren't read in full and a rule that needs a model: a review is never concluded then."""
    status = lambda x: F.when(x["sk"] % 5 == 0, "scanned_no_text").when(x["sk"] % 7 == 1, "mixed_image_unread").otherwise("ok")
    page = lambda x, i: F.struct(i + 1, F.lit(595.0), F.lit(842.0), status(x), F.lit(0), F.lit(""), F.lit(0.0), F.lit(False))
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "paragraph", F.when(x["pk"] % 3 == 0, "附件：承诺书").otherwise("正文"), 0, i + 1), meta=page)
    of = rules.load("id: planted\nname: planted\nrules:\n- {id: K10, type: attachment_checklist, params: {expected: [承诺书]}}\n- {id: K17, type: anonymity_check}")
    return review.summary(docs, of).select("doc_id", "total_issues", "errors", "manual_required_checks", "skipped_checks", "ai_complete", "review_complete", "conclusion")


@query("rule_cross_numbers", LINES + """
v AS (SELECT doc_id, i, pk % 3 = 0 AS whole, CASE WHEN pk % 3 = 0 THEN (pk % 4) || '万元' ELSE (sk % 4) * 10000 || '元' END AS v, CASE WHEN pk % 3 = 0 THEN pk % 4 ELSE sk % 4 END AS n FROM l WHERE pk % 3 < 2),
a AS (SELECT doc_id, v, n, min(i) AS pos, count(*) AS c FROM v WHERE whole GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM a),
t AS (SELECT doc_id, string_agg(v, ' / ' ORDER BY pos) FILTER (r <= 4) AS shown FROM d GROUP BY doc_id HAVING count(*) > 1),
s AS (SELECT doc_id, arg_min(v, i) FILTER (whole) AS lv, arg_min(v, i) FILTER (NOT whole) AS rv, coalesce(list_has_any(list(n) FILTER (whole), list(n) FILTER (NOT whole)), true) AS met FROM v GROUP BY doc_id)
SELECT doc_id, '「预算总额」在多处取值不一致：' || shown AS message FROM t
UNION ALL SELECT doc_id, '字段间取值不一致：「预算总额」为 ' || lv || '，「申请经费」为 ' || rv FROM s WHERE NOT met AND lv IS NOT NULL AND rv IS NOT NULL""")
def rule_cross_numbers(spark, sf_dir):
    """Numbers in units of their own: a field's values among themselves, and those of two fields."""
    text = lambda x: F.when(x["pk"] % 3 == 0, F.concat(F.lit("预算总额："), (x["pk"] % 4).cast("string"), F.lit("万元"))).when(x["pk"] % 3 == 1, F.concat(F.lit("申请经费："), (x["sk"] % 4 * 10000).cast("string"), F.lit("元"))).otherwise("正文")
    docs = order_documents(spark, sf_dir, lambda x, i: ir.block(i, "paragraph", text(x), 0, i + 1))
    return found(docs, "{id: K12, type: cross_field_consistency, params: {fields: [{name: 预算总额, normalize: number}], comparisons: [{left: 预算总额, right: {name: 申请经费}, normalize: number}]}}")


@query("rule_heading_hierarchy", LINES + """
k AS (SELECT doc_id, i, (pk % 3 + 1)::INT AS lev, (sk % 3 + 1)::INT AS a, (sk % 2 + 1)::INT AS b, (price % 2 + 1)::INT AS c, price % 4 = 0 AS cn FROM l WHERE sk % 7 > 0),
n AS (SELECT *, CASE lev WHEN 1 THEN a WHEN 2 THEN b ELSE c END AS num, lev = 1 AND cn AS chinese,
  CASE lev WHEN 1 THEN CASE WHEN cn THEN ['一', '二', '三'][a] || '、' ELSE a || '.' END WHEN 2 THEN a || '.' || b ELSE a || '.' || b || '.' || c END AS prefix FROM k),
w AS (SELECT *, lag(lev) OVER o AS prev_level, lag(chinese) OVER (PARTITION BY doc_id, lev ORDER BY i) AS prior_cn,
  last_value(CASE WHEN lev = 1 THEN num END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a1,
  last_value(CASE lev WHEN 1 THEN 0 WHEN 2 THEN num END IGNORE NULLS) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a2
  FROM n WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
x AS (SELECT *, CASE lev WHEN 1 THEN '' WHEN 2 THEN coalesce(a1, 0)::VARCHAR ELSE coalesce(a1, 0) || '.' || coalesce(a2, 0) END AS ctx FROM w),
y AS (SELECT *, lag(num) OVER (PARTITION BY doc_id, lev, ctx ORDER BY i) AS before,
  count(*) FILTER (prior_cn IS NOT NULL AND prior_cn <> chinese) OVER (PARTITION BY doc_id, lev ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM x)
SELECT doc_id, '标题未使用可识别编号：结语' AS message FROM l WHERE sk % 7 = 0
UNION ALL SELECT doc_id, '第1级标题编号样式不符合要求：' || prefix FROM y WHERE chinese
UNION ALL SELECT doc_id, '标题层级从第' || prev_level || '级跳到第' || lev || '级：' || prefix FROM y WHERE lev > prev_level + 1
UNION ALL SELECT doc_id, '第1级标题混用编号样式：' || CASE WHEN chinese THEN 'arabic / chinese' ELSE 'chinese / arabic' END FROM y WHERE lev = 1 AND chinese <> prior_cn AND known = 0
UNION ALL SELECT doc_id, '标题编号父级不匹配：' || prefix FROM y WHERE lev = 2 AND a1 <> a OR lev = 3 AND a2 > 0 AND a2 <> b
UNION ALL SELECT doc_id, '标题编号不连续：' || before || ' 后出现 ' || prefix FROM y WHERE num <> before + 1""")
def rule_heading_hierarchy(spark, sf_dir):
    """Headings of three levels: jumps, mixed and refused styles, wrong parents, gaps, and headings without a number."""
    s = lambda c: c.cast("string")

    def make(x: Column, i: Column) -> Column:
        a, b, c, level = x["sk"] % 3 + 1, x["sk"] % 2 + 1, x["price"] % 2 + 1, x["pk"] % 3 + 1
        top = F.when(x["price"] % 4 == 0, F.concat(pick(x["sk"], "一", "二", "三"), F.lit("、"))).otherwise(F.concat(s(a), F.lit(".")))
        number = F.when(level == 1, top).when(level == 2, F.concat_ws(".", s(a), s(b))).otherwise(F.concat_ws(".", s(a), s(b), s(c)))
        return ir.block(i, "heading", F.when(x["sk"] % 7 == 0, "结语").otherwise(F.concat(number, F.lit(" 标题"))), 1, i + 2)

    return found(order_documents(spark, sf_dir, make), "{id: K15, type: heading_numbering, params: {require_numbering: true, allowed_styles: {1: [arabic]}, max_issues: 1000}}")


@query("rule_layout_headings", LINES + """
h AS (SELECT doc_id, i, pk % 2 + 1 AS level, CASE WHEN pk % 2 = 0 AND sk % 3 > 0 THEN '字体为SimSun，要求黑体' END AS font, CASE WHEN pk % 2 = 0 AND price % 3 = 0 THEN '字号为12.0pt，要求14pt' WHEN pk % 2 = 1 AND price % 3 = 1 THEN '字号16.0pt过大' END AS size,
  CASE WHEN pk % 2 = 1 AND sk % 2 = 0 THEN '未加粗' END AS bold, CASE WHEN pk % 2 = 0 AND price % 2 = 0 THEN '未按center对齐' END AS way FROM l),
m AS (SELECT doc_id, string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (sk % 4 = 0 AND i > 1) AS lefts, string_agg(i::VARCHAR, ', ' ORDER BY i) FILTER (sk % 5 = 0 AND i > 1) AS bottoms FROM l GROUP BY doc_id)
SELECT doc_id, '第' || level || '级标题版式不符合要求：' || concat_ws('；', font, size, bold, way) AS message FROM h WHERE coalesce(font, size, bold, way) IS NOT NULL
UNION ALL SELECT doc_id, '第[' || lefts || ']页左边距小于 20mm' FROM m WHERE lefts IS NOT NULL
UNION ALL SELECT doc_id, '第[' || bottoms || ']页下边距小于 15mm' FROM m WHERE bottoms IS NOT NULL""")
def rule_layout_headings(spark, sf_dir):
    """Fonts, sizes, weight and alignment of two levels of headings, and margins of all pages but the first."""
    def make(x: Column, i: Column) -> Column:
        none = [F.lit(None).cast("double").alias(c) for c in ("line_spacing_pt", "line_spacing_multiple", "first_line_indent_pt", "left_indent_pt", "right_indent_pt", "space_before_pt", "space_after_pt")]
        layout = F.struct(F.when(x["price"] % 2 == 0, "left").otherwise("center").alias("alignment"), F.lit(1).alias("line_count"), *none)
        size = F.element_at(F.array(F.lit(12.0), F.lit(16.0), F.lit(14.0)), (x["price"] % 3 + 1).cast("int"))
        size = F.when((x["pk"] % 2 == 0) & (x["price"] % 3 == 1), 14.0).otherwise(size)
        box = {"x0": F.when(x["sk"] % 4 == 0, 40.0).otherwise(80.0), "x1": F.lit(500.0), "y0": F.lit(100.0), "y1": F.when(x["sk"] % 5 == 0, 820.0).otherwise(700.0)}
        made = ir.block(i, "heading", F.lit("标题"), x["pk"] % 2 + 1, i + 1).withField("layout", layout).withField("font.size", size)
        made = made.withField("font.name", F.when(x["sk"] % 3 > 0, "SimSun").otherwise("SimHei")).withField("font.bold", x["sk"] % 2 == 1)
        for side, at in box.items():
            made = made.withField(f"bbox.{side}", at)
        return made

    styles = "headings: {1: {font: 黑体, size: 14, alignment: center}, 2: {max_size: 15, bold: true}}, margins_mm: {left_min: 20, bottom_min: 15, exclude_pages: [1]}"
    return found(order_documents(spark, sf_dir, make), f"{{id: K16, type: layout_check, params: {{{styles}, max_issues: 1000}}}}")
