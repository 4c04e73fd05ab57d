"""Watchdogs, reused tasks and expiring keys: streams of several files against the finished table, and the state that is left."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.streaming import limits, tasks


def streamed(spark, tmp_path, frames, f, name):
    """f over the frames as a stream, one file after the other; its rows and its last state."""
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    source = spark.readStream.schema(frames[0].schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = f(source).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    return sorted(map(tuple, spark.sql(f"select * from {name}").collect())), query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]


def test_watched():
    run = lambda rows, now=None: [x[:3] for x in tasks.watched(rows, "queued", 0, 180, now)[0]]
    assert run([(1, "start"), (181, "activity"), (362, "done")]) == [(1, "start", "running"), (181, "activity", "running"), (361, "watchdog", "timed_out"), (362, "done", "timed_out")]
    assert run([(1, "start"), (5, "cancel")], 185) == [(1, "start", "running"), (5, "cancel", "cancelling")]
    assert run([(1, "start"), (5, "cancel")], 186)[-1] == (185, "watchdog", "cancelled")
    assert run([], 999) == [] and run([(1, "cancel")], 999) == [(1, "cancel", "cancelled")]


@pytest.mark.parametrize("late", [0, 50])
def test_watchdog_needs_no_row(spark, tmp_path, late):
    random.seed(late)
    rows = sorted((100 * k + i + 1, f"t{random.randint(0, 9)}", random.choice(["start", "start", "activity", "activity", "cancel", "done"])) for k in range(12) for i in range(5))
    frames = [spark.createDataFrame(rows[i : i + 12], "at long, task string, event string") for i in range(0, 60, 12)]
    whole = spark.createDataFrame(rows, "at long, task string, event string")
    want = sorted(map(tuple, tasks.watched_statuses(whole, 180, late).collect()))
    got, _ = streamed(spark, tmp_path, frames, lambda s: tasks.watched_statuses(s, 180, late), f"watched{late}")
    assert got == want and any(r[2] == "watchdog" for r in got) and len(got) > 60
    assert tasks.watched_statuses(whole.limit(0)).count() == 0


def test_start_comes_first_in_its_second(spark, tmp_path):
    rows = [("a", 1, "activity"), ("a", 1, "start"), ("a", 2, "activity"), ("b", 3, "cancel"), ("b", 3, "start"), ("c", 400, "start")]
    frame = spark.createDataFrame(rows, "task string, at long, event string")
    want = sorted([("a", 1, "start", "running", True), ("a", 1, "activity", "running", True), ("a", 2, "activity", "running", True), ("a", 182, "watchdog", "timed_out", True), ("b", 3, "start", "running", True), ("b", 3, "cancel", "cancelling", True), ("b", 183, "watchdog", "cancelled", True), ("c", 400, "start", "running", True)])
    assert sorted(map(tuple, tasks.watched_statuses(frame).collect())) == want
    first, second = frame.where("task != 'c'"), frame.where("task = 'c'")
    got, _ = streamed(spark, tmp_path, [first, second], tasks.watched_statuses, "same_second")
    assert got == want


def test_reuse(spark, tmp_path):
    random.seed(4)
    rows = [(i, f"k{random.randint(0, 5)}", i, random.choice(["submit", "submit", "done"])) for i in range(60)] + [(60 + i, f"k{i}", 60 + i, "done") for i in range(4)]
    frames = [spark.createDataFrame(rows[i : i + 16], "at long, key string, request long, event string") for i in range(0, 64, 16)]
    want, active = [], {}
    for at, key, request, event in rows:
        if event == "submit":
            want.append((key, at, request, active.setdefault(key, request), active[key] != request))
        else:
            active.pop(key, None)
    assert sorted(map(tuple, tasks.reused(spark.createDataFrame(rows, frames[0].schema)).collect())) == sorted(want)
    got, state = streamed(spark, tmp_path, frames, tasks.reused, "reused")
    assert got == sorted(want) and state == len(active) < 6


def test_idle_keys_leave_the_state(spark, tmp_path):
    frames = [spark.createDataFrame([(100 * k + i, f" U{k}-{i % 4} ", 1000 * k + 10 * i + 1) for i in range(20)], "id long, who string, at long").select("id", limits.user_key(F.col("who")).alias("who"), F.timestamp_seconds("at").alias("at")) for k in range(5)]
    whole = frames[0]
    for x in frames[1:]:
        whole = whole.unionByName(x)
    want = sorted(map(tuple, limits.rate_limited(whole, "who", "at", "id", 3, 60).collect()))
    got, state = streamed(spark, tmp_path, frames, lambda s: limits.rate_limited(s, "who", "at", "id", 3, 60, "5 seconds"), "pruned")
    assert got == want and {r[0] for r in got} == {f"u{k}-{i}" for k in range(5) for i in range(4)}
    assert state <= 4  # of 20 keys
