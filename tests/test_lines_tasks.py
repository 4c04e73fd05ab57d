"""Visual lines and the life of tasks."""

from foliant.operators.lines import visual_lines
from foliant.streaming.tasks import advanced, folded, statuses


def test_lines(spark):
    f = lambda text, x0, y0, h=10: {"text": text, "x0": float(x0), "y0": float(y0), "x1": x0 + 10.0, "y1": y0 + float(h)}
    rows = [f("c", 30, 1), f("b", 20, 0), f(" ", 0, 0), f("d", 0, 20), f("a", 10, 4), f("e", 20, 16)]
    df = spark.createDataFrame([("d", 1, 0, r["text"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows], "doc_id string, page int, block int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line, r.text, r.y0) for r in visual_lines(df).orderBy("line").collect()] == [(0, "abc", 0.0), (1, "de", 16.0)]
    assert "Python" not in visual_lines(df)._jdf.queryExecution().executedPlan().toString() and visual_lines(df.limit(0)).count() == 0


def test_life():
    run = lambda *events: [x[2] for x in folded(list(events))[0]]
    assert run((1, "start"), (2, "done"), (3, "failed"), (4, "cancel")) == ["running", "done", "done", "done"]
    assert run((1, "start"), (2, "cancel"), (3, "done"), (4, "cancelled")) == ["running", "cancelling", "cancelling", "cancelled"]
    assert run((1, "cancel"), (2, "start")) == ["cancelled", "cancelled"]
    assert run((1, "start"), (181, "tick"), (182, "tick")) == ["running", "running", "timed_out"]
    assert run((1, "start"), (100, "activity"), (280, "tick"), (281, "cancel"), (462, "tick")) == ["running", "running", "running", "cancelling", "cancelled"]
    assert advanced("queued", 0, "tick", 999) == ("queued", 0, False) and advanced("queued", 0, "done", 1)[2] is False


def test_statuses_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "start"), ("a", 5, "done"), ("a", 6, "cancel"), ("b", 2, "cancel"), ("b", 3, "start")], "task string, at long, event string")
    want = sorted(map(tuple, statuses(rows).collect()))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = statuses(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("task_statuses").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from task_statuses").collect())) == want and ("a", 6, "cancel", "done", False) in want
