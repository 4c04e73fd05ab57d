"""A lookup whose heavy keys are broadcast and whose others are shuffled gives the plain join."""

import pytest
from pyspark.sql import functions as F

from foliant.llm import common


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 10])
def test_lookup_split(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    big = spark.range(6000).select("id", F.when(F.col("id") < 4000, F.lit(1)).when(F.col("id") < 4010, F.lit(None)).otherwise(F.col("id") % 700).cast("int").alias("key"))
    small = spark.range(500).select(F.col("id").cast("int").alias("key"), (F.col("id") * 3).alias("n"))
    got, want = (sorted(map(tuple, x.select("id", "key", "n").collect())) for x in (common.lookup_split(big, small, "key", 4), big.join(small, "key")))
    assert got == want and len(got) > 5000
    assert common.lookup_split(big, small.limit(0), "key").count() == 0
