"""What reviews make once, and dates."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import formats
from foliant.plans import driver_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, node, most", [("checker_counts", "regexp_extract_all(", 4), ("attachments_and_signatures", "split(", 2), ("attachments_and_signatures", "array_join(", 8)])
def test_findings_are_made_once(spark, name, node, most):
    plan = driver_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(node) <= most


def test_dates(spark):
    good = ["2024年3月5日", " 2024 年 03 月 5 日", "2024-3-5", "2024/03/05", "2024.3-5", "２０２４年３月５日", "2024\t-3-5"]
    bad = ["2024年3月5", "2024年3-5日", "2024-3-5日", "2024-13-5", "2024-2-30", "24-3-5", "2024--3-5", "2024-3-5-", "0000-1-1", "", "2024 3 5", "2024年3月5日x"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "v string").select("v", formats.is_date(F.col("v")).alias("ok")).collect()
    assert [r.v for r in rows if r.ok] == good
