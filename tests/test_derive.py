"""From extracted lines, tables and boxes to blocks."""

from pyspark.sql import functions as F

from foliant.functions import derive as D
from foliant.functions.pages import page_status
from foliant.streaming.limits import admit


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_classes(spark):
    cases = {
        "一、立项依据": ("heading", 1), "十二.甲": ("heading", 1), "（三）乙": ("heading", 2), "1.1 丙": ("heading", 3), "2.3.4丁": ("heading", 3), "1. 戊": ("heading", 2), "1、己": ("heading", 2), "(1) 庚": ("heading", 2),
        "3640.": ("paragraph", 0), "12-15, 30%": ("paragraph", 0), "正文": ("paragraph", 0), "": ("paragraph", 0),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", D.classified(F.col("t"), F.lit(False), F.lit(12.0), F.lit(12.0)).alias("x")).collect()
    assert {r.t: tuple(r.x) for r in rows} == cases
    assert tuple(value(spark, D.classified(F.lit("粗体"), F.lit(True), F.lit(14.0), F.lit(12.0)))) == ("heading", 2)
    assert tuple(value(spark, D.classified(F.lit("粗" * 30), F.lit(True), F.lit(14.0), F.lit(12.0)))) == ("paragraph", 0)


def test_layout_signals(spark):
    doubles = lambda *x: F.array(*[F.lit(float(v)) for v in x]).cast("array<double>")
    assert value(spark, D.body_size(doubles(10.4, 12.1, 11.9, 10.6))) == 10.5 and value(spark, D.body_size(doubles())) == 12.0
    assert value(spark, D.line_spacing(doubles(100, 140, 120, 120))) == 20.0 and value(spark, D.line_spacing(doubles(5))) is None
    assert value(spark, D.first_indent(doubles(96, 72, 74))) == 24.0
    assert [value(spark, D.alignment(F.lit(a), F.lit(b), F.lit(600.0))) for a, b in ((200.0, 400.0), (400.0, 580.0), (72.0, 528.0), (10.0, 590.0))] == ["center", "right", "center", "left"]


def test_tables(spark):
    cells = lambda sql: tuple(value(spark, D.table_cells(F.expr(sql))))
    assert cells("array(array('a', null), array('b'), null)") == ([["a", ""], ["b", ""], ["", ""]], ["1 行为空行，已按空单元格占位", "1 行长度不足最宽行，已补齐空单元格"])
    assert cells("cast(null as array<array<string>>)") == ([], ["表格未提取到任何行"])
    assert cells("array(cast(null as array<string>))") == ([], ["表格未提取到任何单元格"])
    assert value(spark, D.table_text(F.expr("array(array('a', 'b'), array('c', ''))"))) == "a b | c "


def test_boxes(spark):
    box = lambda a, b, c, d: F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((a, b, c, d), ("x0", "y0", "x1", "y1"), strict=True)])
    blocks = F.array(F.struct(F.lit("in").alias("id"), box(10, 10, 20, 20).alias("bbox")), F.struct(F.lit("near").alias("id"), box(51, 10, 60, 20).alias("bbox")), F.struct(F.lit("out").alias("id"), box(53, 10, 60, 20).alias("bbox")))
    assert [b.id for b in value(spark, D.outside_tables(blocks, F.array(box(0, 0, 50, 50))))] == ["out"]
    assert value(spark, D.image_share(F.array(box(0, 0, 10, 50), box(0, 0, 10, 100)), F.lit(100.0), F.lit(100.0))) == 0.15
    unread = lambda *t: value(spark, D.unread_image(F.array(box(0, 0, 100, 60)), F.array(*t), F.lit(100.0), F.lit(100.0)))
    assert unread(box(0, 70, 10, 80)) and not unread(box(0, 10, 10, 20))


def test_page_status(spark):
    s = lambda chars=0, images=0, ratio=0.0, unread=False, state="not_attempted", ocr=0: value(spark, page_status(F.lit(chars), F.lit(images), F.lit(ratio), F.lit(unread), F.lit(state), F.lit(ocr), 20))
    assert [s(state="success", ocr=20), s(state="success", ocr=19), s(state="insufficient"), s(state="failed"), s(state="skipped_limit")] == ["ocr", "ocr_insufficient", "ocr_insufficient", "ocr_failed", "ocr_skipped_limit"]
    assert [s(), s(images=1), s(199, 1, 0.6), s(200, 1, 0.6, True), s(200, 1, 0.6), s(state="disabled", images=1)] == ["empty", "scanned_no_text", "scanned_minimal_text", "mixed_image_unread", "ok", "scanned_no_text"]


def test_chunks_and_places(spark):
    packed = value(spark, D.chunks(F.array(*map(F.lit, ["aaa", "bb", "c" * 9, "d", "e"])), F.length, 5, "string"))
    assert packed == [["aaa", "bb"], ["c" * 9], ["d", "e"]]
    blocks = F.array(*[F.struct(F.lit(t).alias("text")) for t in ("x y", "正 文\n内容")])
    assert value(spark, D.placed(F.lit("文内 容"), blocks)).text == "正 文\n内容" and value(spark, D.placed(F.lit(" "), blocks)) is None


def test_limiter():
    times, out = [], []
    for t in (0, 1, 2, 60, 61, 62):
        times, ok = admit(times, t, 2, 60)
        out.append(ok)
    assert out == [True, True, False, False, True, True]
