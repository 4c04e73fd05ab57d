"""Operators of the operational tables and of event-time windows, over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import store
from foliant.plans.driver_queries import query, table
from foliant.streaming import tasks, windows


@query("consent_granted", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def consent_granted(spark, sf_dir):
    consents = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.consented(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), consents, "c_custkey", F.col("o_orderstatus") == "P")


@query("task_progress", """
WITH r AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 5 ELSE 1 END AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS ord FROM lineitem)
SELECT l_orderkey, ord, least(90, 30 + (60 * sum(w) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING)) // sum(w) OVER (PARTITION BY l_orderkey))::INT AS progress FROM r""")
def task_progress(spark, sf_dir):
    weight = F.when(F.col("l_returnflag") == "R", 5).otherwise(1)
    return store.progress(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], weight)


@query("text_validity", r"""
WITH d AS (SELECT doc_id, coalesce(list_sum(list_transform(string_split(text, chr(10)), lambda t: length(regexp_replace(t, '^\s+|\s+$', '', 'g')))), 0)::BIGINT AS chars FROM documents)
SELECT doc_id, chars, chars >= 80 AS valid FROM d""")
def text_validity(spark, sf_dir):
    chars, valid = store.readable(F.split(F.coalesce("text", F.lit("")), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", chars.alias("chars"), valid.alias("valid"))


@query("unread_gate", """
SELECT conv_id, count(*) AS failing, string_agg(turn::VARCHAR || ' ' || role, '；' ORDER BY turn, turn::VARCHAR || ' ' || role) AS detail FROM conversations WHERE length(text) < 60 GROUP BY conv_id""")
def unread_gate(spark, sf_dir):
    return store.gated(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") < 60, F.concat_ws(" ", F.col("turn").cast("string"), "role"))


@query("current_versions", """
SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS active, max(CASE WHEN event_type IN ('view', 'cart') THEN event_id END) AS working, max(event_id) + 1 AS next_version FROM events GROUP BY user_id""")
def current_versions(spark, sf_dir):
    kind = F.col("event_type")
    return store.versions(table(spark, sf_dir, "events"), "user_id", "event_id", kind == "purchase", kind.isin("view", "cart"))


@query("latest_test", """
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) ON o_custkey = c_custkey AND n = 1""")
def latest_test(spark, sf_dir):
    tests = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return store.latest_test(table(spark, sf_dir, "customer").select("c_custkey"), tests, ["c_custkey"], "o_orderkey", "o_orderkey", "o_orderstatus")


@query("hourly_events", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def hourly_events(spark, sf_dir):
    return windows.tumbling(table(spark, sf_dir, "events"), ["event_type"], "ts", "1 hour")


@query("event_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600 * 1000000::BIGINT THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, sf_dir):
    return windows.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "6 hours")


IDLE, LATE = 7200, 600


@query("watched_tasks", f"""
WITH e AS (SELECT user_id, epoch(ts)::BIGINT AS sec, row_number() OVER w AS n, lag(epoch(ts)::BIGINT) OVER w AS prior FROM (SELECT user_id, time_bucket(INTERVAL 1 SECOND, ts) AS ts, event_id FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, min(prior) AS ended FROM e WHERE sec - prior > {IDLE} GROUP BY user_id),
t AS (SELECT user_id, max(sec) AS last FROM e GROUP BY user_id),
f AS (SELECT t.user_id, coalesce(ended, CASE WHEN (SELECT max(sec) FROM e) - {LATE} - last > {IDLE} THEN last END) AS ended FROM t LEFT JOIN g USING (user_id))
SELECT user_id::VARCHAR AS task, sec AS "at", CASE WHEN n = 1 THEN 'start' ELSE 'beat' END AS event, CASE WHEN sec > ended THEN 'timed_out' ELSE 'running' END AS status, coalesce(sec <= ended, true) AS applied FROM e JOIN f USING (user_id)
UNION ALL SELECT user_id::VARCHAR, ended + {IDLE}, 'watchdog', 'timed_out', true FROM f WHERE ended IS NOT NULL""")
def watched_tasks(spark, sf_dir):
    """Each user's events as one task's life, which idleness ends."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"), "event_id")
    first = events.groupBy("task").agg(F.min(F.struct("at", "event_id")).alias("first"))
    named = events.join(first, "task").select("task", "at", F.when(F.col("event_id") == F.col("first.event_id"), "start").otherwise("activity").alias("event"))
    return tasks.watched_statuses(named, IDLE, LATE).withColumn("event", F.when(F.col("event") == "activity", "beat").otherwise(F.col("event")))


@query("reused_tasks", """
WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id, event_type, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events WHERE event_type IN ('view', 'click', 'purchase')),
s AS (SELECT *, first_value(event_id) OVER (PARTITION BY user_id, part ORDER BY us, event_id) AS task FROM e WHERE event_type <> 'purchase')
SELECT user_id::VARCHAR AS key, us AS "at", event_id AS request, task, task <> event_id AS reused FROM s""")
def reused_tasks(spark, sf_dir):
    events = table(spark, sf_dir, "events").where("event_type in ('view', 'click', 'purchase')")
    return tasks.reused(events.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("request"), F.when(F.col("event_type") == "purchase", "done").otherwise("submit").alias("event")))
