"""Unicode forms of all code points, spans to blocks, the report of an evaluation."""

import unicodedata

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import metrics
from foliant.sources import spans

SPAN = "doc_id string, page int, span_id string, text string, font string, size double, flags int, color int, x0 double, y0 double, x1 double, y1 double"


def test_forms_of_all_code_points(spark):
    every = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "c string").repartition(4).select("c", text.compatible(F.col("c")).alias("n"), text.casefolded(F.col("c")).alias("f")).collect()
    assert len(rows) == len(every)
    assert [(r.c, r.n) for r in rows if r.n != unicodedata.normalize("NFKC", r.c)] == []
    assert [(r.c, r.f) for r in rows if r.f != r.c.casefold()] == []


def test_forms_of_texts(spark):
    given = ["Ｐ１２（ａ）　ﬁne ①②㎏ ½", "Straße ŒUVRE ΑΣ İ", "plain", "", None, "ﬃ" * 1000 + "ﬃﬁ"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, c string").select("i", text.compatible(F.col("c")).alias("n"), text.casefolded(F.col("c")).alias("f")).collect()
    for r in rows:
        t = given[r.i]
        assert (r.n, r.f) == ((None, None) if t is None else (unicodedata.normalize("NFKC", t), t.casefold()))


def test_blocks_in_reading_order(spark):
    rows = [
        ("a", 1, "10", "late", "SimSun", 12.0, 0, 0, 5.0, 50.0, 9.0, 60.0), ("a", 1, "9", " same place ", "", 12.0, 12, 7, 5.0, 50.0, 9.0, 60.0), ("a", 1, "2", "Title", "Unknown", 14.26, 22, None, 0.0, 10.0, 9.0, 20.0), ("a", None, "1", None, None, None, None, None, None, None, None, None),
        ("b", 2, "1", "x", "", 9.0, 8, 0, 0.0, 0.0, 1.0, 1.0),
    ]
    tables = spark.createDataFrame([("a", 1, "t", [["k", None], ["v"]], 0.0, 30.0, 9.0, 40.0), ("c", 1, "t", None, 0.0, 0.0, 1.0, 1.0)], "doc_id string, page int, span_id string, cells array<array<string>>, x0 double, y0 double, x1 double, y1 double")
    found = spans.blocks(spark.createDataFrame(rows, SPAN), tables)
    got = sorted(found.collect(), key=lambda r: (r.doc_id, r.ord))
    assert [(r.doc_id, r.ord, r.block_id, r.type, r.level) for r in got] == [("a", 0, "1", "paragraph", 0), ("a", 1, "2", "heading", 2), ("a", 2, "t", "table", 0), ("a", 3, "10", "paragraph", 0), ("a", 4, "9", "paragraph", 0), ("b", 0, "1", "paragraph", 0), ("c", 0, "t", "table", 0)]
    fonts = {(r.doc_id, r.block_id): tuple(r.font) for r in got}
    assert fonts["a", "2"] == ("宋体", 14.3, True, True, 0) and fonts["a", "9"] == ("等线", 12.0, False, False, 7) and fonts["a", "10"][0] == "SimSun" and fonts["a", "1"] == ("黑体", 0.0, False, False, 0)
    assert got[2].table_data == [["k", ""], ["v", ""]] and got[2].parse_warnings and got[6].parse_warnings
    assert {(r.doc_id, r.page): r.text_chars for r in spans.page_chars(found).collect()} == {("a", 0): 0, ("a", 1): 4 + 10 + 5 + len(got[2].text.strip()), ("b", 2): 1, ("c", 1): 0}
    assert spans.blocks(spark.createDataFrame([], SPAN), tables.limit(0)).count() == 0


def test_report(spark):
    pairs = spark.createDataFrame([("s", "a|b", "error", "tp_identified", True), ("s", "a|b", "error", "fp", False), ("t", "c", "info", "fn", False), ("t", "c", "error", "tp_unverified", False)], "sample_id string, checker string, severity string, outcome string, page_shifted boolean")
    rows = {(r.scope, r.sample_id, r.checker, r.severity): r for r in metrics.evaluation_report(pairs).collect()}
    assert len(rows) == 1 + 2 + 2 + 3 + 2
    every = rows["all", None, None, None]
    assert (every.tp_identified, every.tp_unverified, every.fp, every.fn, every.page_mismatches, every.precision_ppm, every.recall_ppm, every.f1_ppm) == (1, 1, 1, 1, 1, 666666, 666666, 666666)
    assert rows["checker", None, "a|b", None].markdown.startswith("| checker | - | a\\|b | - | 1 | 0 | 1 | 0 |") and rows["severity", None, None, "info"].precision_ppm is None
    assert rows["checker+severity", None, "c", "info"].json == '{"scope":"checker+severity","checker":"c","severity":"info","tp_identified":0,"tp_unverified":0,"fp":0,"fn":1,"page_mismatches":0,"recall_ppm":0,"f1_ppm":0}'
    assert metrics.evaluation_report(pairs.limit(0)).count() == 0
