"""Rule sets by folder and by document."""

import pytest
from pyspark.sql import functions as F

from foliant.plans import evaluation_queries, ir, review, rules


def test_scan(spark, tmp_path):
    for i, text in enumerate(evaluation_queries.SETS):
        (tmp_path / f"{i}.{'yml' if i else 'yaml'}").write_text(text)
    (tmp_path / "notes.txt").write_text("no rules")
    found = rules.scan(spark, str(tmp_path))
    assert sorted(found) == ["signed", "small", "whole"] and found["small"].rules[0].params == {"max_pages": 8}
    (tmp_path / "again.yaml").write_text(evaluation_queries.SETS[0])
    with pytest.raises(rules.RuleError, match="small"):
        rules.scan(spark, str(tmp_path))


def test_each_document_under_its_rule_set(spark):
    docs = ir.from_lines(spark.createDataFrame([(i, "研究内容\ntext") for i in range(4)], "doc_id long, text string")).withColumn("set", F.element_at(F.array(*map(F.lit, ("whole", "signed", "lost", "?"))), F.col("doc_id").cast("int") + 1))
    docs = docs.withColumn("set", F.when(F.col("set") != "?", F.col("set")))
    sets = {x.id: x for x in map(rules.load, evaluation_queries.SETS)}
    got = {r.doc_id: r for r in review.reviewed_by(docs, sets, "set").collect()}
    for doc_id, name in (("0", "whole"), ("1", "signed")):
        alone = review.reviewed(docs.where(F.col("doc_id") == doc_id), sets[name]).first()
        assert got[doc_id].found == alone.found and got[doc_id].statuses == alone.statuses
    assert [got[i].found[0].f.message for i in "23"] == ["规则集 lost 不存在", "规则集  不存在"] and {got[i].statuses[0].status for i in "23"} == {"failed"}
    assert review.reviewed_by(docs.limit(0), sets, "set").count() == 0
