"""Steps that the rules share: what they give, and that their work doesn't multiply."""

from pyspark.sql import functions as F

from foliant.functions import columns, formats, text
from foliant.operators import checks
from foliant.plans import guideline, ir


def optimized(df):
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_is_the_patterns(spark):
    """Of all characters, alone and around a text, those go that the patterns took."""
    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'utf-32')").alias("c"))
    both = every.select(F.concat("c", F.lit("a b"), "c").alias("t"), F.concat(F.lit("a"), "c", F.lit("b")).alias("u"), F.concat("c", "c").alias("v"))
    same = (columns.strip(F.col("t")) == F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "")) & (columns.strip(F.col("v")) == F.regexp_replace("v", r"(?U)\A\s+|\s+\z", ""))
    same = same & (F.translate("u", columns.WHITE, "") == F.regexp_replace("u", r"(?U)\s+", "")) & (F.translate("u", columns.WHITE + "_＿-—–/\\.。·", "") == F.regexp_replace("u", r"(?U)[\s_＿\-—–/\\.。·]+", ""))
    assert both.count() == 0x110000 - 2048 and both.where(~F.coalesce(same, F.lit(False))).count() == 0


def test_characters_are_tested_by_range(spark):
    """A pattern of single characters tests each of a thousand for each character of a text."""
    for name in ("nfkc", "casefold"):
        _, _, pattern, _, plain = text._table(name)
        assert pattern.count("\\x") < 400 and plain.count("\\x") < 12
    rows = spark.createDataFrame([("A中文1.0万",), ("ﬁ２０㍿",), ("ß中",), ("",), (None,)], "t string").select(text.compatible(F.col("t")).alias("n"), text.casefolded(F.col("t")).alias("f"))
    assert [tuple(r) for r in rows.collect()] == [("A中文1.0万", "a中文1.0万"), ("fi20株式会社", "fi２０㍿"), ("ß中", "ss中"), ("", ""), (None, None)]


def test_changed_blocks_are_made_once(spark):
    made = ir.block(F.col("id"), "paragraph", F.concat(F.lit("marker"), F.col("id").cast("string"))).withField("font.name", F.lit("x")).withField("font.size", F.lit(1.0)).withField("bbox.x0", F.lit(2.0))
    rows = spark.range(3).select(F.transform(F.array("id"), lambda x: made).alias("b"))
    assert optimized(rows).count("marker") == 2  # the text, and its words
    assert rows.select(F.col("b").cast(f"array<{ir.BLOCK}>")).collect() == rows.collect()


def test_a_mode_reads_its_values_once(spark):
    rows = spark.range(3).select(columns.mode(F.transform(F.array("id"), lambda x: F.concat(F.lit("marker"), x.cast("string")))).alias("m"))
    assert optimized(rows).count("marker") == 1 and [r.m for r in rows.collect()] == ["marker0", "marker1", "marker2"]
    named = spark.range(3).select(checks.font_name(F.concat(F.lit("marker"), F.col("id").cast("string"))).alias("m"))
    assert optimized(named).count("marker") == 1


def test_an_amount_reads_its_cell_once(spark):
    cells = ["12", " (1,234.50) ", "３万元", "￥5", "1.2.3", "-", "", None, "(-7)", "((8))", "9\u3000元", "x"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [None if r.v is None else float(r.v) for r in rows.select(formats.amount(F.col("c")).alias("v")).collect()]
    assert got == [12.0, -1234.5, 3.0, 5.0, None, None, None, None, 7.0, -8.0, 9.0, None]
    assert optimized(spark.range(3).select(formats.amount(F.concat(F.lit("marker"), F.col("id").cast("string"))).alias("v"))).count("marker") == 1


def test_equal_requirements_are_read_once(spark):
    """Texts are read below a join by their distinct ones, whatever guideline they are of."""
    same = '{"kind": "page_limit", "detail": {"max_pages": 3}}'
    rows = spark.createDataFrame([(g, o, same if o else '{"detail":{"max_pages":3},"kind":"page_limit"}') for g in range(40) for o in range(2)] + [(50, 1, None), (51, 1, "no json")], "guideline long, ord int, requirement string")
    found = guideline.mapped(rows)
    plan = optimized(found)
    assert 0 < plan.find("Join Inner") < plan.lower().find("parsejson")
    got = found.collect()
    assert len(got) == 40 and {(r.guideline, r.ord, r.rule_id, r.params) for r in got} == {(g, 0, "G001", '{"max_pages":3}') for g in range(40)}
