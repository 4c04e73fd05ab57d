"""What a review hands on, and the operational tables."""

import json

from pyspark.sql import functions as F

from foliant.operators import store
from foliant.plans import ir, rules
from foliant.sources import results

RULES = """
id: small
name: small
rules:
- {id: R01, type: required_sections, severity: error, params: {sections: [{title: "Aims"}, {title: "Plan"}]}}
"""


def test_result_json(spark):
    docs = ir.from_lines(spark.createDataFrame([(1, "Aims\n" + "x" * 90), (2, "Aims\nPlan"), (3, None)], "doc_id long, text string"))
    found = {r.doc_id: json.loads(r.result) for r in results.result_json(docs, rules.load(RULES)).collect()}
    assert found["1"]["summary"]["errors"] == 1 and found["1"]["findings"][0]["rule_id"] == "R01"
    assert found["2"]["findings"] == [] and found["2"]["summary"]["conclusion"] == "pass"
    assert found["3"]["summary"]["errors"] == 2


FOUND = "doc_id string, rule_ord int, seq int, rule_id string, checker string, severity string, page int, bbox struct<x0:double,y0:double,x1:double,y1:double>, message string, suggestion string"


def test_annotations_and_summary_lines(spark):
    rows = [
        ("a", 0, 0, "R1", "k", "error", 1, (-5.0, 10.0, 700.0, 20.0), "m", "s"), ("a", 0, 1, "R2", "k", "other", 1, (10.0, 10.0, 10.0, 20.0), "empty", "s"),
        ("a", 1, 0, "R3", "k", "info", None, None, "y" * 50, None), ("b", 1, 0, "R3", "k", "info", 2, None, "one\nline", None),
    ]
    found = spark.createDataFrame(rows, FOUND)
    pages = spark.createDataFrame([("a", 1, 595.0, 842.0)], "doc_id string, page int, width double, height double")
    (only,) = results.annotations(found, pages).collect()
    assert tuple(only.rect) == (0.0, 10.0, 595.0, 20.0) and only.colour == [1.0, 0.0, 0.0] and only.content == "[R1] m｜建议：s"
    lines = {(r.doc_id, r.line): r.text for r in results.summary_lines(found).collect()}
    assert lines == {("a", 0): "1. [R3] " + "y" * 34, ("a", 1): "y" * 16, ("b", 0): "1. [R3] one line"}


def test_batches_are_summed_up_once_complete(spark):
    summaries = spark.createDataFrame([("d1", "pass", 0, 0, 0)], "doc_id string, conclusion string, errors int, warnings int, infos int")
    items = [("x", "d1", "a.pdf", "done", "t"), ("x", "d2", "b.pdf", "failed", "t"), ("y", "d1", "a.pdf", "done", "t"), ("y", "d3", "c.pdf", "running", None)]
    rows = results.batch_summary(summaries, spark.createDataFrame(items, "batch_id string, doc_id string, filename string, status string, review_time string")).collect()
    assert sorted((r.batch_id, r["文件名"], r["结论"]) for r in rows) == [("x", "a.pdf", "pass"), ("x", "b.pdf", None)]


def test_tests_of_rule_sets(spark):
    rows = [("t1", "error", "rule", "m", 3), ("t1", "info", "llm", "AI 检查未执行：x", 3), ("t2", "error", "system", "m", 3), ("t3", "info", "rule", "m", 0)]
    found = spark.createDataFrame(rows, "t string, severity string, layer string, message string, executed int")
    one = {r.t: (r.success, r.release_eligible, r.degraded_checks) for r in store.test_outcome(found, "t", F.col("executed")).collect()}
    assert one == {"t1": (True, True, 1), "t2": (False, False, 0), "t3": (False, False, 0)}
    assert not store.test_outcome(found, "t", F.col("executed"), with_model=True).where("t = 't1'").first().success
