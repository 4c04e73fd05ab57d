"""The driver's heap doesn't go on growing by what finished stages left."""

from __future__ import annotations

import time

import pytest

from foliant.llm import common


def used(spark) -> int:
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    return runtime.totalMemory() - runtime.freeMemory()


def test_garbage_goes(spark):
    held = [spark.sparkContext._gateway.new_array(spark._jvm.long, 1 << 20) for _ in range(5)]
    before = used(spark)
    del held
    time.sleep(1)  # the gateway lets go of them in a thread of its own
    assert common.give_back(spark, 0) and used(spark) < before - (10 << 20)
    assert not common.give_back(spark, 1.01)


@pytest.mark.parametrize("own", [True, False])
def test_heap_is_watched_while_a_step_runs(spark, monkeypatch, own):
    looks = []
    monkeypatch.setattr(common, "own_heap", lambda spark: own)
    monkeypatch.setattr(common, "HEAP_SECONDS", 0.01)
    monkeypatch.setattr(common, "give_back", lambda spark: bool(looks.append(1)))
    kept = common.kept_table(spark.range(3), "watched")
    assert sorted(x.id for x in kept.collect()) == [0, 1, 2] and bool(looks) == own
    n = len(looks)
    spark.range(3).collect()
    assert len(looks) == n


def test_failed_step_ends_its_watcher(spark, monkeypatch):
    monkeypatch.setattr(common, "own_heap", lambda spark: True)
    with pytest.raises(Exception, match="boom"):
        common.kept_table(spark.range(1).selectExpr("raise_error('boom') AS x"), "failed")
    assert not [t for t in common.threading.enumerate() if "watch" in t.name]


def test_masters(spark):
    assert not common.own_heap(spark)
