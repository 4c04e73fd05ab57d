"""A rule set's life as a log: each refusal, conflicts, what follows from it; other rule sets and odd logs beside it."""

from pyspark.sql import functions as F

from foliant.operators import command_log

#: command, what it takes, and the refusal, version and state that must follow.
LIFE = [
    ("save", {"version": 1}, "unknown", None, None), ("clone", {}, "no_source", None, None), ("seed", {"content": "a", "enabled_rules": 2}, None, 1, "published"), ("seed", {"content": "b"}, "exists", None, None), ("delete", {}, "published", None, None),
    ("save", {"version": 1, "revision": 1, "content": "x"}, "not_editable", 1, "published"), ("clone", {"source": 7}, "no_source", None, None), ("clone", {"actor": "ann"}, None, 2, "draft"), ("clone", {}, "open_version", None, None),
    ("save", {"version": 9, "revision": 1, "content": "x"}, "no_version", None, None), ("save", {"version": 2, "revision": 1, "content": ""}, "invalid", 2, "draft"), ("save", {"version": 2, "revision": 1, "content": "b", "enabled_rules": 0}, None, 2, "draft"), ("save", {"version": 2, "revision": 1, "content": "c"}, "conflict", 2, "draft"),
    ("submit", {"version": 2, "actor": "bob"}, "no_reviewer", 2, "draft"), ("submit", {"version": 2, "actor": "bob", "reviewer": "bob"}, "own_review", 2, "draft"), ("submit", {"version": 2, "actor": "bob", "reviewer": "cat"}, "untested", 2, "draft"), ("test", {"version": 2}, None, 2, "draft"),
    ("approve", {"version": 2, "actor": "cat"}, "not_submitted", 2, "draft"), ("submit", {"version": 2, "actor": "bob", "reviewer": "cat"}, None, 2, "submitted"), ("submit", {"version": 2, "actor": "bob", "reviewer": "cat"}, "not_draft", 2, "submitted"), ("save", {"version": 2, "revision": 2, "content": "c"}, "not_editable", 2, "submitted"),
    ("approve", {"version": 2, "actor": "dan"}, "not_reviewer", 2, "submitted"), ("reject", {"version": 2, "actor": "cat", "note": " "}, "no_note", 2, "submitted"), ("reject", {"version": 2, "actor": "cat", "note": "more"}, None, 2, "rejected"), ("clone", {}, "open_version", None, None),
    ("submit", {"version": 2, "actor": "bob", "reviewer": "ann"}, "not_draft", 2, "rejected"), ("save", {"version": 2, "revision": 2, "content": "b", "enabled_rules": 0}, None, 2, "draft"), ("submit", {"version": 2, "actor": "bob", "reviewer": "ann"}, None, 2, "submitted"), ("approve", {"version": 2, "actor": "ann"}, "own_version", 2, "submitted"),
    ("reject", {"version": 2, "actor": "ann", "note": "x"}, "own_version", 2, "submitted"), ("publish", {"version": 2, "actor": "ann"}, "not_approved", 2, "submitted"), ("disable", {}, None, 1, "published"), ("enable", {}, None, 1, "published"), ("fly", {}, "unknown_command", None, None), (None, {}, "unknown_command", None, None),
]
PUBLISHED = [
    ("seed", {"content": "a", "enabled_rules": 1}, None, 1, "published"), ("clone", {"actor": "ann"}, None, 2, "draft"), ("save", {"version": 2, "revision": 1, "content": "b", "enabled_rules": 3}, None, 2, "draft"), ("test", {"version": 2}, None, 2, "draft"), ("submit", {"version": 2, "actor": "bob", "reviewer": "cat"}, None, 2, "submitted"),
    ("approve", {"version": 2, "actor": "cat"}, None, 2, "approved"), ("publish", {"version": 2, "actor": "bob"}, "not_reviewer", 2, "approved"), ("disable", {}, None, 1, "published"), ("publish", {"version": 2, "actor": "cat"}, None, 2, "published"), ("clone", {"source": 1}, None, 3, "draft"), ("delete", {}, "published", None, None), ("disable", {}, None, 2, "published"),
]


def logged(spark, *lives):
    fields = [x.split()[0] for x in command_log.COMMAND.split(", ")]
    rows = [tuple({"ruleset_id": name, "seq": i, "command": command, **given}.get(f) for f in fields) for name, life in lives for i, (command, given, *_) in enumerate(life)]
    return spark.createDataFrame(rows, command_log.COMMAND).repartition(5)


def test_lives(spark):
    done = command_log.outcomes(logged(spark, ("one", LIFE), ("two", PUBLISHED), (None, LIFE)))
    got = {(r.ruleset_id, r.seq): r for r in done.collect()}
    assert len(got) == len(LIFE) + len(PUBLISHED)
    for name, life in (("one", LIFE), ("two", PUBLISHED)):
        for i, (command, _, *want) in enumerate(life):
            r = got[name, i]
            assert [r.refused, r.version, r.state] == want, (name, i, command)
    assert [(r.seq, r.retired, r.active, r.status) for r in got.values() if r.retired] == [(8, 1, 2, "active")]
    assert {(r.ruleset_id, r.version): (r.state, r.revision, r.content) for r in command_log.versions(done).collect()} == {
        ("one", 1): ("published", 1, "a"), ("one", 2): ("submitted", 3, "b"), ("two", 1): ("retired", 1, "a"), ("two", 2): ("published", 2, "b"), ("two", 3): ("draft", 1, "a"),
    }
    assert {tuple(r) for r in command_log.statuses(done).collect()} == {("one", 1, "active"), ("two", 2, "disabled")}
    assert command_log.audit(done).where("ruleset_id = 'two'").count() == 10


def test_deletion_and_empty_logs(spark):
    # only a rule set that was never published can go; such come from imports, so the fold is asked directly
    state = command_log.RuleSetState(versions={1: command_log.Version("draft", "a", 1, "ann")}, last=1)
    blank = dict.fromkeys(("version", "revision", "source", "content", "enabled_rules", "reviewer", "note", "actor"))
    assert state.apply(blank | {"command": "enable"}) == ("never_published", None, None)
    assert state.apply(blank | {"command": "delete"}) == (None, None, None) and not state.versions
    state = command_log.RuleSetState(versions={1: command_log.Version("submitted", "a", 1, "ann")}, last=1)
    assert state.apply(blank | {"command": "delete"})[0] == "not_editable"
    empty = command_log.outcomes(logged(spark, ("one", LIFE)).limit(0))
    assert empty.count() == command_log.versions(empty).count() == command_log.statuses(empty).count() == 0
    narrow = logged(spark, ("one", PUBLISHED)).select("ruleset_id", "seq", "command").withColumn("more", F.lit(1))
    assert command_log.outcomes(narrow).where("refused is null").count() > 0
