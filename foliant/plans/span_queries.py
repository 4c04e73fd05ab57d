"""Blocks from raw spans and tables over the driver's tables, and the report of an evaluation, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import metrics
from foliant.plans import evaluation_queries as evaluation
from foliant.plans.driver_queries import query, table
from foliant.sources import spans

TEXTS = ("一、标题", "正文内容", "12", "（一）小节", "1.1 次级")
#: Spans made from lines, and a table for each order.
SPANS = {
    "doc_id": "l_orderkey", "page": "l_linenumber % 3 + 1", "span_id": "concat('s', l_linenumber, '-', l_partkey, '-', l_suppkey)", "text": f"element_at(array{TEXTS!r}, cast(l_partkey % 5 + 1 AS int))", "font": "IF(l_partkey % 4 = 0, '', 'SimSun')",
    "size": "10 + l_partkey % 3 * 0.5D", "flags": "l_suppkey % 32", "color": "l_suppkey", "x0": "l_suppkey % 3 * 10D", "y0": "l_partkey % 5 * 20D", "x1": "500D", "y1": "l_partkey % 5 * 20D + 12",
}
TABLES = {"doc_id": "o_orderkey", "page": "1", "span_id": "'t1'", "cells": "array(array('科目', '金额'), array(o_orderpriority, null), array('合计'))", "x0": "10D", "y0": "40D", "x1": "500D", "y1": "90D"}
S_SQL = f"""s AS (SELECT l_orderkey AS doc_id, (l_linenumber % 3 + 1)::INT AS page, 's' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS block_id, {list(TEXTS)!r}[l_partkey % 5 + 1] AS text, l_partkey % 5 AS t,
  l_partkey % 4 = 0 AS unnamed, 10 + l_partkey % 3 * 0.5::DOUBLE AS size, l_suppkey % 32 AS flags, (l_suppkey % 3 * 10)::DOUBLE AS x0, (l_partkey % 5 * 20)::DOUBLE AS y0 FROM lineitem),
z AS (SELECT doc_id, size, count(*) AS n, min((page, y0, x0, block_id)) AS first_at FROM s GROUP BY ALL),
m AS (SELECT doc_id, size AS body FROM z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) = 1),
f AS (SELECT doc_id, page, block_id, text, x0, y0, CASE WHEN unnamed THEN CASE WHEN flags & 8 > 0 THEN '等线' WHEN flags & 4 > 0 THEN '宋体' ELSE '黑体' END ELSE 'SimSun' END AS font, size, flags & 16 > 0 AS bold, flags & 2 > 0 AS italic, t, body FROM s JOIN m USING (doc_id)),
b AS (SELECT doc_id, page, block_id, text, x0, y0, font, size, bold, italic, CASE WHEN t IN (0, 3, 4) OR (t = 1 AND bold AND size > body) THEN 'heading' ELSE 'paragraph' END AS type,
  CASE WHEN t = 0 THEN 1 WHEN t = 3 THEN 2 WHEN t = 4 THEN 3 WHEN t = 1 AND bold AND size > body THEN 2 ELSE 0 END AS level FROM f
  UNION ALL SELECT o_orderkey, 1, 't1', '科目 金额 | ' || o_orderpriority || '  | 合计 ', 10, 40, '宋体', 0, false, false, 'table', 0 FROM orders)"""


def found(spark, sf_dir):
    made = lambda name, fields: table(spark, sf_dir, name).selectExpr(*[f"{x} AS {c}" for c, x in fields.items()])
    return spans.blocks(made("lineitem", SPANS), made("orders", TABLES))


@query("span_blocks", f"""
WITH {S_SQL}
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0, block_id) - 1)::INT AS ord, block_id, page, type, level, text, font, size, bold, italic FROM b""")
def span_blocks(spark, sf_dir):
    return found(spark, sf_dir).select("doc_id", "ord", "block_id", "page", "type", "level", "text", F.col("font.name").alias("font"), "font.size", "font.bold", "font.italic")


@query("page_chars", f"WITH {S_SQL} SELECT doc_id, page, sum(length(trim(text)))::INT AS text_chars FROM b GROUP BY ALL")
def page_chars(spark, sf_dir):
    return spans.page_chars(found(spark, sf_dir))


R_SQL = evaluation.SQL_IDENTITY


@query("evaluation_report", f"""
WITH pairs AS ({R_SQL}),
c AS (SELECT CASE WHEN grouping(sample_id) = 0 THEN 'sample_id' WHEN grouping(checker) = 0 AND grouping(severity) = 0 THEN 'checker+severity' WHEN grouping(checker) = 0 THEN 'checker' WHEN grouping(severity) = 0 THEN 'severity' ELSE 'all' END AS scope,
  sample_id, checker, severity, count(*) FILTER (outcome = 'tp_identified') AS tp_identified, count(*) FILTER (outcome = 'tp_unverified') AS tp_unverified, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn,
  count(*) FILTER (page_shifted) AS page_mismatches FROM pairs GROUP BY GROUPING SETS ((), (checker), (severity), (checker, severity), (sample_id))),
r AS (SELECT *, tp_identified + tp_unverified AS tp FROM c),
p AS (SELECT scope, sample_id, checker, severity, tp_identified, tp_unverified, fp, fn, page_mismatches, CASE WHEN tp + fp > 0 THEN 1000000 * tp // (tp + fp) END AS precision_ppm, CASE WHEN tp + fn > 0 THEN 1000000 * tp // (tp + fn) END AS recall_ppm,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2000000 * tp // (2 * tp + fp + fn) END AS f1_ppm FROM r)
SELECT *, '{{"scope":"' || scope || '"' || coalesce(',"sample_id":"' || sample_id || '"', '') || coalesce(',"checker":"' || checker || '"', '') || coalesce(',"severity":"' || severity || '"', '') || ',"tp_identified":' || tp_identified || ',"tp_unverified":' || tp_unverified
  || ',"fp":' || fp || ',"fn":' || fn || ',"page_mismatches":' || page_mismatches || coalesce(',"precision_ppm":' || precision_ppm, '') || coalesce(',"recall_ppm":' || recall_ppm, '') || coalesce(',"f1_ppm":' || f1_ppm, '') || '}}' AS json,
  '| ' || concat_ws(' | ', scope, coalesce(sample_id, '-'), coalesce(checker, '-'), coalesce(severity, '-'), tp_identified, tp_unverified, fp, fn, page_mismatches, coalesce(precision_ppm::VARCHAR, '-'), coalesce(recall_ppm::VARCHAR, '-'), coalesce(f1_ppm::VARCHAR, '-')) || ' |' AS markdown FROM p""")
def evaluation_report(spark, sf_dir):
    return metrics.evaluation_report(metrics.identity_pairs(*evaluation.instances(spark, sf_dir)))
