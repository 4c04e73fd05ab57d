"""Null texts beyond the broadcast dictionary don't meet in one task."""

from pyspark.sql import functions as F

from foliant.llm import pieces


def test_null_texts_are_dealt(spark):
    docs = spark.createDataFrame([(i, None if i % 4 else f"text {i} of many words{i}") for i in range(2000)], "doc_id long, text string").repartition(4)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = pieces.encode(docs, pieces.Pieces(), hot=0).withColumn("part", F.spark_partition_id())
        rows = out.where("text is null").groupBy("part").agg(F.count("*").alias("n"), F.sum("encoded.n_tokens").alias("tokens")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in rows) == 1500 and sum(r.tokens for r in rows) == 0 and len(rows) == 4 and max(r.n for r in rows) < 600
