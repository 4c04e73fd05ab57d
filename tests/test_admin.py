"""Names, answers and times; tasks after a restart; sessions; the actions on versions by hand."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import admin


def values(spark, f, given, kind="string"):
    rows = spark.createDataFrame(list(enumerate(given)), f"i int, x {kind}").select("i", f(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_safe_filename(spark):
    given = ["a/b.pdf", r"c:\x\甲 乙.docx", "a:b?.pdf", "../..", "/", "", None, "dir/", "dir/.", " n ", "t\tx", "y" * 200]
    assert values(spark, text.safe_filename, given) == ["b.pdf", "甲 乙.docx", "a_b_.pdf", "..", "unnamed", "unnamed", "unnamed", "dir", "dir", "n", "t_x", "y" * 180]


def test_answers(spark):
    given = ['{"a": 1}', ' ```json\n{"a": 1}\n``` ', '```\n[1]\n```', "```json\n{}", "no", '"x"', "", None]
    assert values(spark, text.unfenced, given) == ['{"a": 1}', '{"a": 1}', "[1]", "{}", "no", '"x"', "", None]
    assert values(spark, text.json_object, given) == ['{"a": 1}', '{"a": 1}', None, "{}", None, None, None, None]


def test_iso_time(spark):
    assert values(spark, text.iso_time, [dt.datetime(2024, 1, 2, 3, 4, 5, 678, tzinfo=dt.UTC), None], "timestamp") == ["2024-01-02T03:04:05+00:00", ""]


def test_recovery(spark):
    tasks = spark.createDataFrame([(1, "running", "check", 95, None, True, "k"), (2, "running", "check", 95, None, None, "k"), (3, "done", "done", 100, "d", True, "k"), (4, "queued", "wait", None, None, False, "k")], "id int, status string, stage string, progress int, completed_at string, cancel boolean, `odd.name` string")
    left = admin.recovered(tasks, F.col("status").isin("running", "queued"), F.col("cancel"), F.lit("now"))
    assert left.columns == tasks.columns
    assert {r[0]: tuple(r)[1:5] for r in left.collect()} == {1: ("cancelled", "cancelled", 100, "now"), 2: ("queued", "recovered", 90, None), 3: ("done", "done", 100, "d"), 4: ("queued", "recovered", 0, None)}


def test_sessions(spark):
    rows = [(1, "u", None, None), (2, "u", 5, None), (3, "u", None, 10), (4, "u", None, 11), (5, "v", None, None), (6, None, None, None)]
    sessions = spark.createDataFrame(rows, "id int, user_id string, revoked_at int, expires_at int")
    assert sorted(r.id for r in admin.active_sessions(sessions, F.lit("u"), F.lit(10)).collect()) == [1, 4]


def test_actions(spark):
    columns = "version_id int, ruleset_id int, state string, assigned_reviewer string, submitted_by string, created_by string, content_sha256 string, enabled_rules int, actor string, note string"
    rows = [
        (1, 1, "approved", "r", "s", "c", "x", 1, "r", ""), (2, 1, "approved", "r", "s", "c", "x", 0, "r", ""), (3, 1, "approved", "r", "s", "r", "x", 1, "r", ""), (4, 1, "approved", "r", "s", "c", "y", 1, "r", ""),
        (5, 1, "approved", "r", "s", "c", "x", 1, None, ""), (6, 1, None, "r", "s", "c", "x", 1, "r", ""), (7, 2, "submitted", "r", "s", "c", "x", 1, "r", " ok"), (8, 2, "submitted", "r", "s", "c", "x", 1, "r", " "),
    ]
    versions = spark.createDataFrame(rows, columns)
    tests = spark.createDataFrame([(1, 1, "x", "done"), (2, 1, "x", "done"), (4, 1, "y", "failed")], "version_id int, ruleset_id int, content_sha256 string, status string")
    of = lambda action: {r.version_id: (r.refused, r.next_state) for r in admin.judged(versions, tests, action).collect()}
    assert {k: v[0] for k, v in of("publish").items()} == {1: None, 2: "no_enabled_rule", 3: "own_version", 4: "untested", 5: "not_reviewer", 6: "not_approved", 7: "not_approved", 8: "not_approved"}
    assert of("publish")[1] == (None, "published") and of("publish")[6] == ("not_approved", None)
    assert of("approve")[7] == (None, "approved") and of("reject")[7] == (None, "rejected") and of("reject")[8] == ("no_note", "submitted")
    chosen = versions.where("version_id = 1").select("version_id", "ruleset_id")
    before = versions.withColumn("state", F.when(F.col("version_id").isin(2, 7), "published").otherwise(F.col("state")))
    assert {r.version_id: r.state for r in admin.published(before, chosen).collect() if r.version_id in (1, 2, 7, 4)} == {1: "published", 2: "retired", 7: "published", 4: "approved"}


def test_clones(spark):
    rows = [(1, 1, "published", "a"), (1, 2, "retired", "b"), (2, 1, "published", "a"), (2, 2, "rejected", "b"), (3, 1, "retired", "c"), (3, 2, None, "d"), (4, 7, "published", None)]
    versions = spark.createDataFrame(rows, "ruleset_id int, number int, state string, content string")
    got = {r.ruleset_id: tuple(r)[1:] for r in admin.cloned(versions, F.col("state") == "published", ["content"], F.lit("me")).collect()}
    none = (None, None, None, None, None)
    assert got == {1: (3, "draft", "me", 1, "a", None), 2: (*none, "open_version"), 3: (*none, "no_source"), 4: (8, "draft", "me", 7, None, None)}
    older = {r.ruleset_id: r.cloned_from for r in admin.cloned(versions, F.col("number") == 2, ["content"], F.lit("me")).collect()}
    assert older == {1: 2, 2: None, 3: 2, 4: None}
