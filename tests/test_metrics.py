"""Evaluation metrics, the streaming limiter, and what the driver calls."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import keyed, metrics
from foliant.streaming.limits import rate_limited


def identified(expected, predicted):
    """(expected id, predicted id, outcome) of one group, instance by instance: lists of (id, page, anchors) and of (id, page, text)."""
    left, out = sorted(predicted, key=lambda p: (str(p[1] or ""), p[2], p[0])), []
    ordered = sorted(expected, key=lambda e: (str(e[1] or ""), e[0]))
    for e in (e for e in ordered if e[2]):
        hit = next((p for p in left if all(a in p[2] for a in e[2])), None)
        if hit:
            left.remove(hit)
        out.append((e[0], hit[0], "tp_identified") if hit else (e[0], None, "fn"))
    for e in (e for e in ordered if not e[2]):
        out.append((e[0], left.pop(0)[0], "tp_unverified") if left else (e[0], None, "fn"))
    return sorted(out + [(None, p[0], "fp") for p in left], key=str)


def test_identity_pairs_of_random_samples(spark):
    random.seed(11)
    es, ps, want = [], [], {}
    for sample in range(120):
        e = [(i, random.choice([None, 1, 2, 10]), random.sample("abcd", random.choice([0, 1, 1, 2]))) for i in range(random.randint(0, 7))]
        p = [(i, random.choice([None, 1, 3, 10]), "".join(sorted(random.sample("abcd", random.randint(0, 4))))) for i in range(random.randint(0, 7))]
        es += [(str(sample), "k", "error", i, page, anchors) for i, page, anchors in e]
        ps += [(str(sample), "k", "error", i, page, "", text, None, None, "R") for i, page, text in p]
        if e or p:
            want[str(sample)] = identified(e, p)
    expected = spark.createDataFrame(es, "sample_id string, checker string, severity string, instance_id long, page int, anchors array<string>")
    predicted = spark.createDataFrame(ps, "sample_id string, checker string, severity string, instance_id long, page int, evidence string, message string, suggestion string, block_id string, rule_id string")
    got = {}
    for r in metrics.identity_pairs(expected, predicted).collect():
        got.setdefault(r.sample_id, []).append((r.expected_id, r.predicted_id, r.outcome))
    assert {k: sorted(v, key=str) for k, v in got.items()} == want
    assert metrics.identity_pairs(expected.limit(0), predicted.limit(0)).count() == 0


def test_a_prediction_meets_equal_anchors_once():
    """Over instances with few sets of anchors, the work is a prediction's sets, not its group's instances."""
    held = []

    class Text(str):
        def __contains__(self, words):
            held.append(words)
            return super().__contains__(words)

    waiting = metrics.Waiting()
    for i in range(3000):
        waiting.expect(i, None, [f"[{i % 3}]"])
    assert all(waiting.meet(Text("[9]")) == ("fp", None, None) for _ in range(1000)) and len(held) <= 3000
    assert [waiting.meet(Text(t))[1] for t in ("[1]", "[2][0]", "[0]", "[1]", "[2]")] == [1, 0, 3, 4, 2]
    waiting.expect(3000, 7, [])
    assert waiting.meet("[9]") == ("tp_unverified", 3000, 7) and waiting.missed() == list(range(5, 3000))


def test_instance_pairs(spark):
    expected = spark.createDataFrame([("k", 1, 10, "b"), ("k", 2, 2, "b"), (None, 3, None, "a")], "checker string, instance_id long, page int, message string")
    predicted = spark.createDataFrame([("k", 7, 2, "a"), ("k", 8, 10, "z"), ("k", 9, 2, "a"), ("j", 6, 1, "")], "checker string, instance_id long, page int, message string")
    got = {tuple(r) for r in metrics.instance_pairs(expected, predicted, ["checker"]).collect()}
    assert got == {("k", 1, "tp", 1, 8), ("k", 2, "tp", 2, 7), ("k", 3, "fp", None, 9), ("", 1, "fn", 3, None), ("j", 1, "fp", None, 6)}


def test_identity_match(spark):
    expected = spark.createDataFrame([("s", "k", "error", 1, ["a"]), ("s", "k", "error", None, None), ("t", "k", "error", None, None)], "sample_id string, checker string, severity string, page int, anchors array<string>")
    predicted = spark.createDataFrame([("s", "k", "error", 1, "has a", "m", "", None, "R1"), ("u", "k", "error", 1, "", "m", "", None, "R1")], "sample_id string, checker string, severity string, page int, evidence string, message string, suggestion string, block_id string, rule_id string")
    got = {r.sample_id: tuple(r)[3:] for r in metrics.identity_match(expected, predicted).collect()}
    assert got == {"s": (1, 0, 0, 1, 0), "t": (0, 0, 0, 1, 0), "u": (0, 0, 1, 0, 0)}
    flags = {r.sample_id: (r.tp, r.fp, r.fn) for r in metrics.set_match(expected, predicted, ["sample_id", "checker"]).collect()}
    assert flags == {"s": (1, 0, 0), "t": (0, 0, 1), "u": (0, 1, 0)}


def test_rates(spark):
    rows = spark.createDataFrame([(3, 1, 0), (0, 0, 0)], "tp long, fp long, fn long")
    assert [(r.precision, r.recall, r.f1) for r in keyed.rates(rows).collect()] == [(0.75, 1.0, 0.857143), (None, None, None)]


def test_streaming_limiter_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 2}", f"2024-01-01 00:00:{i % 60:02d}") for i in range(60)], "id long, who string, at string").withColumn("at", F.col("at").cast("timestamp"))
    batch = {(r.id, r.admitted) for r in rate_limited(rows, "who", "at", "id", 3, 10).collect()}
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = rate_limited(stream, "who", "at", "id", 3, 10).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.id, r.admitted) for r in spark.sql("select * from limited").collect()} == batch
    assert 0 < sum(a for _, a in batch) < 60


def test_entry():
    import __spark_entry__ as e

    assert "review_summary" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["review_summary", "numbering_gap", "section_words"])
def test_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
