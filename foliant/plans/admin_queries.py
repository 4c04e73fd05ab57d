"""Administration of rule sets, purges, recovery, sessions and parser dispatch, over the driver's tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.text import safe_filename
from foliant.operators import admin, command_log
from foliant.plans.driver_queries import query, table
from foliant.sources import parsers

STATES = "CASE WHEN o_totalprice < 40000 THEN 'published' WHEN o_orderstatus = 'O' THEN 'approved' WHEN o_orderstatus = 'F' THEN 'submitted' ELSE 'draft' END"
#: Columns of versions made from orders; the actor is the reviewer but for every third rule set's.
COLUMNS = {
    "version_id": "o_orderkey", "ruleset_id": "o_custkey", "number": "o_orderkey", "state": STATES, "content_sha256": "o_orderpriority",
    "assigned_reviewer": "CASE WHEN o_orderkey % 7 <> 0 THEN concat('u', o_orderkey % 4) END", "submitted_by": "concat('u', o_custkey % 4)", "created_by": "concat('u', o_custkey % 3)",
    "actor": "CASE WHEN o_custkey % 3 = 0 THEN concat('u', o_custkey % 5) ELSE concat('u', o_orderkey % 4) END",
}
V_SQL = f"v AS (SELECT {', '.join(f'{c} AS {name}' for name, c in COLUMNS.items())} FROM orders)"
TESTED = "o_totalprice > 150000 AND o_orderstatus = 'F'"


def versions(spark, sf_dir):
    return table(spark, sf_dir, "orders").selectExpr(*[f"{c} AS {name}" for name, c in COLUMNS.items()])


def tests_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 150000").selectExpr("o_orderkey AS version_id", "o_custkey AS ruleset_id", "o_orderpriority AS content_sha256", "IF(o_orderstatus = 'F', 'done', 'failed') AS status")


def _enabled(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' OR l_quantity > 45").groupBy(F.col("l_orderkey").alias("version_id")).agg(F.count("*").alias("enabled_rules"))


@query("version_publish", f"""
WITH {V_SQL}, t AS (SELECT DISTINCT o_custkey AS ruleset_id, o_orderpriority AS content_sha256 FROM orders WHERE {TESTED}),
e AS (SELECT DISTINCT l_orderkey AS version_id FROM lineitem WHERE l_returnflag = 'A' OR l_quantity > 45),
r AS (SELECT version_id, state, CASE WHEN state <> 'approved' THEN 'not_approved' WHEN actor IS DISTINCT FROM assigned_reviewer THEN 'not_reviewer' WHEN actor IN (submitted_by, created_by) THEN 'own_version'
  WHEN version_id NOT IN (SELECT version_id FROM e) THEN 'no_enabled_rule' WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.ruleset_id = v.ruleset_id AND t.content_sha256 = v.content_sha256) THEN 'untested' END AS refused FROM v)
SELECT version_id, refused, CASE WHEN refused IS NULL THEN 'published' ELSE state END AS next_state FROM r""")
def version_publish(spark, sf_dir):
    of = versions(spark, sf_dir).join(_enabled(spark, sf_dir), "version_id", "left")
    return admin.judged(of, tests_of(spark, sf_dir), "publish", note="actor").select("version_id", "refused", "next_state")


@query("version_submit", f"""
WITH {V_SQL}, t AS (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000 AND o_orderkey % 2 = 0),
r AS (SELECT version_id, state, CASE WHEN state <> 'draft' THEN 'not_draft' WHEN assigned_reviewer IS NULL THEN 'no_reviewer' WHEN assigned_reviewer = submitted_by THEN 'own_review'
  WHEN version_id NOT IN (SELECT o_orderkey FROM t) THEN 'untested' END AS refused FROM v)
SELECT version_id, refused, CASE WHEN refused IS NULL THEN 'submitted' ELSE state END AS next_state FROM r""")
def version_submit(spark, sf_dir):
    tests = tests_of(spark, sf_dir).withColumn("status", F.when(F.col("version_id") % 2 == 0, "done").otherwise("queued"))
    return admin.judged(versions(spark, sf_dir), tests, "submit", actor="submitted_by").select("version_id", "refused", "next_state")


@query("version_reject", f"""
WITH {V_SQL}, r AS (SELECT version_id, state, CASE WHEN state <> 'submitted' THEN 'not_submitted' WHEN actor IS DISTINCT FROM assigned_reviewer THEN 'not_reviewer' WHEN actor IN (submitted_by, created_by) THEN 'own_version'
  WHEN version_id % 3 = 0 THEN 'no_note' END AS refused FROM v)
SELECT version_id, refused, CASE WHEN refused IS NULL THEN 'rejected' ELSE state END AS next_state FROM r""")
def version_reject(spark, sf_dir):
    noted = versions(spark, sf_dir).withColumn("note", F.when(F.col("version_id") % 3 == 0, " \n").otherwise("more"))
    return admin.judged(noted, tests_of(spark, sf_dir), "reject").select("version_id", "refused", "next_state")


@query("versions_published", f"""
WITH {V_SQL}, n AS (SELECT ruleset_id, max(version_id) AS new_id FROM v WHERE state = 'approved' GROUP BY ruleset_id)
SELECT version_id, CASE WHEN version_id = new_id THEN 'published' WHEN new_id IS NOT NULL AND state = 'published' THEN 'retired' ELSE state END AS state FROM v LEFT JOIN n USING (ruleset_id)""")
def versions_published(spark, sf_dir):
    of = versions(spark, sf_dir)
    chosen = of.where("state = 'approved'").groupBy("ruleset_id").agg(F.max("version_id").alias("version_id"))
    return admin.published(of, chosen).select("version_id", "state")


@query("versions_cloned", f"""
WITH {V_SQL}, g AS (SELECT ruleset_id, max(number) AS last, bool_or(state IN ('draft', 'rejected', 'submitted', 'approved')) AS working, max(number) FILTER (state = 'published') AS number,
  arg_max(content_sha256, number) FILTER (state = 'published') AS content_sha256 FROM v WHERE version_id % 3 = 0 OR state = 'published' GROUP BY ruleset_id),
r AS (SELECT *, CASE WHEN working THEN 'open_version' WHEN number IS NULL THEN 'no_source' END AS refused FROM g)
SELECT ruleset_id, CASE WHEN refused IS NULL THEN last + 1 END AS number, CASE WHEN refused IS NULL THEN 'draft' END AS state, CASE WHEN refused IS NULL THEN 'admin' END AS created_by,
  CASE WHEN refused IS NULL THEN number END AS cloned_from, CASE WHEN refused IS NULL THEN content_sha256 END AS content_sha256, refused FROM r""")
def versions_cloned(spark, sf_dir):
    """Rule sets with an open version aren't cloned; fewer versions than in the other queries, so that some have none."""
    fewer = versions(spark, sf_dir).where("version_id % 3 = 0 OR state = 'published'")
    return admin.cloned(fewer, F.col("state") == "published", ["content_sha256"], F.lit("admin"))


#: A log made from orders: a customer's first order seeds, the second clones, further ones do one of five things by their key.
LOG_SQL = """o AS (SELECT o_custkey::VARCHAR AS ruleset_id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
c AS (SELECT *, CASE n WHEN 1 THEN 'seed' WHEN 2 THEN 'clone' ELSE ['save', 'clone', 'delete', 'disable', 'enable'][seq % 5 + 1] END AS command FROM o),
s AS (SELECT *, count(*) FILTER (command = 'save') OVER w AS saves, coalesce(arg_max(command, seq) FILTER (command IN ('disable', 'enable')) OVER w, 'enable') AS switch,
  max(seq) FILTER (command = 'save' AND first) OVER w AS saved FROM (SELECT *, command = 'save' AND row_number() OVER (PARTITION BY ruleset_id, command ORDER BY seq) = 1 AS first FROM c) WINDOW w AS (PARTITION BY ruleset_id ORDER BY seq))"""


def rule_set_log(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ruleset_id"), F.col("o_orderkey").alias("seq"))
    first = orders.groupBy("ruleset_id").agg(F.slice(F.array_sort(F.collect_list("seq")), 1, 2).alias("first"))
    further = F.element_at(F.array(*map(F.lit, ("save", "clone", "delete", "disable", "enable"))), (F.col("seq") % 5 + 1).cast("int"))
    command = F.when(F.col("seq") == F.get("first", F.lit(0)), "seed").when(F.col("seq") == F.get("first", F.lit(1)), "clone").otherwise(further)
    content = F.when(command == "seed", "first").otherwise(F.concat(F.lit("text "), F.col("seq").cast("string")))
    return orders.join(first, "ruleset_id").select("ruleset_id", "seq", command.alias("command"), F.lit("me").alias("actor"), F.lit(2).alias("version"), F.lit(1).alias("revision"), content.alias("content"), F.lit(1).alias("enabled_rules"))


@query("command_outcomes", f"""
WITH {LOG_SQL}
SELECT ruleset_id, seq, command, CASE command WHEN 'save' THEN CASE WHEN saves > 1 THEN 'conflict' END WHEN 'clone' THEN CASE WHEN n > 2 THEN 'open_version' END WHEN 'delete' THEN 'published' END AS refused,
  CASE WHEN command IN ('seed', 'disable', 'enable') THEN 1 WHEN command = 'save' OR n = 2 THEN 2 END::BIGINT AS version, CASE WHEN command = 'save' THEN 2 WHEN command IN ('seed', 'disable', 'enable') OR n = 2 THEN 1 END::BIGINT AS revision,
  CASE WHEN switch = 'disable' THEN 'disabled' ELSE 'active' END AS status FROM s""")
def command_outcomes(spark, sf_dir):
    """Saves of a revision that others have changed are conflicts, second drafts and deletions are refused."""
    return command_log.outcomes(rule_set_log(spark, sf_dir)).select("ruleset_id", "seq", "command", "refused", "version", "revision", "status")


@query("versions_of_log", f"""
WITH {LOG_SQL}
SELECT ruleset_id, 1::BIGINT AS version, 'published' AS state, 1::BIGINT AS revision, 'first' AS content FROM s WHERE n = 1
UNION ALL SELECT ruleset_id, 2, 'draft', CASE WHEN max(saves) > 0 THEN 2 ELSE 1 END, coalesce('text ' || max(saved), 'first') FROM s GROUP BY ruleset_id HAVING max(n) > 1""")
def versions_of_log(spark, sf_dir):
    return command_log.versions(command_log.outcomes(rule_set_log(spark, sf_dir)))


@query("purge_totals", """
WITH d AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0), r AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM d))
SELECT 'documents' AS kind, count(*) AS n FROM d UNION ALL SELECT 'reviews', count(*) FROM r
UNION ALL SELECT 'batch_items', count(*) FROM lineitem WHERE l_suppkey IN (SELECT c_custkey FROM d) OR l_orderkey IN (SELECT o_orderkey FROM r)""")
def purge_totals(spark, sf_dir):
    documents = table(spark, sf_dir, "customer").where("c_acctbal < 0").selectExpr("c_custkey AS document")
    reviews, items = table(spark, sf_dir, "orders").selectExpr("o_custkey AS document", "o_orderkey AS review"), table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS document", "l_orderkey AS review")
    return admin.purge_totals(documents, reviews, items, "document", "review")


@query("task_recovery", """
WITH t AS (SELECT o_orderkey, o_orderstatus AS status, o_orderstatus IN ('O', 'P') AS active, o_orderpriority = '5-LOW' AS cancel, o_orderkey % 101 AS progress FROM orders)
SELECT o_orderkey, CASE WHEN active AND cancel THEN 'cancelled' WHEN active THEN 'queued' ELSE status END AS status, CASE WHEN active AND cancel THEN 'cancelled' WHEN active THEN 'recovered' ELSE 'done' END AS stage,
  CASE WHEN active AND cancel THEN 100 WHEN active THEN least(progress, 90) ELSE progress END AS progress FROM t""")
def task_recovery(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderstatus AS status", "'done' AS stage", "o_orderkey % 101 AS progress", "o_orderdate AS completed_at", "o_orderpriority AS cancel")
    return admin.recovered(tasks, F.col("status").isin("O", "P"), F.col("cancel") == "5-LOW", F.col("completed_at")).select("o_orderkey", "status", "stage", "progress")


@query("active_sessions", """
WITH s AS (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN user_id + 1 ELSE user_id END AS owner, CASE WHEN event_type = 'purchase' THEN ts END AS revoked_at, CASE WHEN event_type <> 'view' THEN value END AS expires_at FROM events)
SELECT event_id, user_id FROM s WHERE user_id = owner AND revoked_at IS NULL AND (expires_at IS NULL OR expires_at > 50)""")
def active_sessions(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "IF(event_id % 10 = 0, user_id + 1, user_id) AS owner", "IF(event_type = 'purchase', ts, NULL) AS revoked_at", "IF(event_type <> 'view', value, NULL) AS expires_at")
    return admin.active_sessions(sessions, F.col("owner"), F.lit(50)).select("event_id", "user_id")


@query("safe_filenames", r"""
WITH p AS (SELECT page_id, url, list_filter(string_split(replace(coalesce(url, ''), '\', '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM pages),
c AS (SELECT page_id, substr(regexp_replace(regexp_replace(coalesce(parts[-1], ''), '^\s+|\s+$', '', 'g'), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), 1, 180) AS name FROM p)
SELECT page_id, CASE WHEN name = '' THEN 'unnamed' ELSE name END AS name FROM c""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", safe_filename(F.col("url")).alias("name"))


@query("parser_dispatch", """
WITH f AS (SELECT c_custkey, c_name || CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.v2.DOCX' WHEN 2 THEN '.tar.gz' ELSE '' END AS filename FROM customer),
e AS (SELECT c_custkey, CASE WHEN contains(filename, '.') THEN lower(string_split(filename, '.')[-1]) ELSE '' END AS ending FROM f)
SELECT c_custkey, CASE WHEN ending IN ('pdf', 'docx') THEN ending END AS parser, CASE WHEN ending NOT IN ('pdf', 'docx') THEN 'Unsupported file extension: .' || ending END AS reason FROM e""")
def parser_dispatch(spark, sf_dir):
    files = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name || CASE c_custkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.v2.DOCX' WHEN 2 THEN '.tar.gz' ELSE '' END AS filename")
    by_parser, unread = parsers.dispatched(files)
    found = unread.select("c_custkey", F.lit(None).cast("string").alias("parser"), "reason")
    for name, rows in by_parser.items():
        found = found.unionByName(rows.select("c_custkey", F.lit(name).alias("parser"), F.lit(None).cast("string").alias("reason")))
    return found


@query("stale_documents", "SELECT o_orderkey, coalesce(o_orderpriority = '1-URGENT' AND nullif(o_orderstatus, 'P') = 'F', false) AS valid FROM orders")
def stale_documents(spark, sf_dir):
    parsed = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority AS schema_version", "nullif(o_orderstatus, 'P') AS parser_fingerprint")
    valid, stale = parsers.split_by_validity(parsed, "1-URGENT", "F")
    return valid.select("o_orderkey", F.lit(True).alias("valid")).unionByName(stale.select("o_orderkey", F.lit(False).alias("valid")))
