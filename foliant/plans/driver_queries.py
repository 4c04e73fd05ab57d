"""Operators applied to the driver's tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import keyed
from foliant.plans import ir, review, rules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EVENT_ORDER = ["view", "click", "cart", "purchase"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("budget_detail_vs_total", """
SELECT o_orderkey AS orderkey, total::DOUBLE AS total, detail_sum::DOUBLE AS detail_sum, (detail_sum - total)::DOUBLE AS gap FROM
  (SELECT o_orderkey, o_totalprice::DECIMAL(20,4) AS total FROM orders) o
  JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(20,4))::DECIMAL(24,4) AS detail_sum FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
WHERE abs(detail_sum - total) > 0.01""")
def budget_detail_vs_total(spark, sf_dir):
    details = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_extendedprice")
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    found = keyed.detail_vs_total(details, totals, "orderkey", F.col("l_extendedprice"), F.col("o_totalprice"))
    return found.select("orderkey", *[F.col(c).cast("double").alias(c) for c in ("total", "detail_sum", "gap")])


@query("budget_ratio_cap", """
WITH p AS (SELECT l_orderkey, l_returnflag, sum(l_extendedprice::DECIMAL(20,4))::DECIMAL(24,4) AS part FROM lineitem GROUP BY ALL),
w AS (SELECT *, (sum(part) OVER (PARTITION BY l_orderkey))::DECIMAL(24,4) AS whole FROM p)
SELECT l_orderkey, l_returnflag, part::DOUBLE AS part, whole::DOUBLE AS whole FROM w WHERE whole > 0 AND part > whole * CASE l_returnflag WHEN 'R' THEN 0.5 WHEN 'A' THEN 0.6 END""")
def budget_ratio_cap(spark, sf_dir):
    found = keyed.shares_over_cap(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_extendedprice"), {"R": 0.5, "A": 0.6})
    return found.select("l_orderkey", "l_returnflag", F.col("part").cast("double").alias("part"), F.col("whole").cast("double").alias("whole"))


@query("numbering_gap", """
WITH m AS (SELECT l_orderkey, max(l_linenumber) AS m, list(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(list_filter(range(1, m + 1), lambda x: NOT list_contains(s, x)), ',') AS missing FROM m WHERE m > len(s)""")
def numbering_gap(spark, sf_dir):
    return keyed.numbering_gaps(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("sequence_break", """
SELECT conv_id, before, after FROM (SELECT conv_id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, turn AS after FROM conversations) WHERE after <> before + 1""")
def sequence_break(spark, sf_dir):
    return keyed.sequence_breaks(table(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("section_order", f"""
WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first_at, list_position({EVENT_ORDER!r}, event_type) AS position FROM events WHERE event_type IN {tuple(EVENT_ORDER)!r} GROUP BY user_id, event_type),
d AS (SELECT *, position < lag(position) OVER (PARTITION BY user_id ORDER BY first_at) AS dropped FROM f),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_at) AS n FROM d WHERE dropped)
SELECT user_id, event_type, position FROM e WHERE n = 1""")
def section_order(spark, sf_dir):
    return keyed.first_order_drop(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], EVENT_ORDER)


@query("required_items_anti", f"""
SELECT user_id, item AS missing FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest({EVENT_ORDER!r}) AS item) i
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = i.item)""")
def required_items_anti(spark, sf_dir):
    return keyed.missing_items(table(spark, sf_dir, "events"), "user_id", "event_type", EVENT_ORDER)


@query("date_neighbourhood", """
SELECT event_id, user_id, ts, near_min, near_max, near_rows FROM (
  SELECT *, min(value) OVER w AS near_min, max(value) OVER w AS near_max, count(*) OVER w AS near_rows
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) WHERE event_type = 'purchase'""")
def date_neighbourhood(spark, sf_dir):
    near = keyed.neighbourhood(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", "value")
    return near.select("event_id", "user_id", "ts", "near_min", "near_max", "near_rows")


@query("cross_field_agree", """
SELECT l_orderkey, count(*) AS occurrences, count(DISTINCT l_shipdate) AS distinct_values, min(l_shipdate) AS low, max(l_shipdate) AS high
FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY l_orderkey HAVING count(*) >= 2 AND count(DISTINCT l_shipdate) > 1""")
def cross_field_agree(spark, sf_dir):
    return keyed.disagreements(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_shipdate")


@query("mode_first_seen", """
SELECT user_id, event_type AS mode, times FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY times DESC, first_at) AS n FROM (SELECT user_id, event_type, count(*) AS times, min((ts, event_id)) AS first_at FROM events GROUP BY ALL)) WHERE n = 1""")
def mode_first_seen(spark, sf_dir):
    return keyed.mode_first_seen(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("dedupe_sha256", "SELECT sha256(text) AS sha256, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_sha256(spark, sf_dir):
    return keyed.first_copies(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("latest_per_key", """
SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_key(spark, sf_dir):
    return keyed.latest_per_key(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type", "ts")


@query("topk_recent", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def topk_recent(spark, sf_dir):
    return keyed.most_recent(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["ts", "event_id"], 500)


@query("stale_tasks", """
SELECT user_id, ts, floor((epoch_us(nx) - epoch_us(ts)) / 1000000)::BIGINT AS idle_seconds FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx FROM events)
WHERE epoch_us(nx) - epoch_us(ts) > 43200 * 1000000::BIGINT""")
def stale_tasks(spark, sf_dir):
    return keyed.stale(table(spark, sf_dir, "events"), "user_id", "ts", 43_200)


@query("heading_numbering", """
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, (l_partkey % 3 + 1)::INT AS level, (l_suppkey % 4 + 1)::INT AS number FROM lineitem),
a AS (SELECT *, lag(level) OVER (PARTITION BY l_orderkey ORDER BY ord) AS prev_level,
  sum((level < 1)::INT) OVER (PARTITION BY l_orderkey ORDER BY ord) AS g1, sum((level < 2)::INT) OVER (PARTITION BY l_orderkey ORDER BY ord) AS g2, sum((level < 3)::INT) OVER (PARTITION BY l_orderkey ORDER BY ord) AS g3 FROM r),
b AS (SELECT *, CASE level WHEN 1 THEN g1 WHEN 2 THEN g2 ELSE g3 END AS g FROM a),
c AS (SELECT *, lag(number) OVER (PARTITION BY l_orderkey, level, g ORDER BY ord) AS last FROM b)
SELECT l_orderkey, ord, CASE WHEN level > coalesce(prev_level, 0) + 1 THEN 'level_jump' ELSE 'discontinuity' END AS fault, coalesce(last, 0) + 1 AS expected
FROM c WHERE level > coalesce(prev_level, 0) + 1 OR number <> coalesce(last, 0) + 1""")
def heading_numbering(spark, sf_dir):
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", o.alias("ord"), (F.col("l_partkey") % 3 + 1).cast("int").alias("level"), (F.col("l_suppkey") % 4 + 1).cast("int").alias("number"))
    return keyed.heading_faults(rows, "l_orderkey", "ord", "level", "number")


@query("instance_match_metrics", """
WITH e AS (SELECT 'junk' AS checker, source, count(*) AS e FROM labels JOIN documents USING (doc_id) WHERE quality = 0 GROUP BY ALL),
p AS (SELECT 'junk' AS checker, source, count(*) AS p FROM documents WHERE n_chars < 400 GROUP BY ALL),
c AS (SELECT checker, source, least(coalesce(e, 0), coalesce(p, 0)) AS tp, greatest(coalesce(p, 0) - coalesce(e, 0), 0) AS fp, greatest(coalesce(e, 0) - coalesce(p, 0), 0) AS fn FROM e FULL JOIN p USING (checker, source))
SELECT *, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1 FROM c""")
def instance_match_metrics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    expected = table(spark, sf_dir, "labels").where("quality = 0").join(docs, "doc_id").select(F.lit("junk").alias("checker"), "source")
    predicted = docs.where("n_chars < 400").select(F.lit("junk").alias("checker"), "source")
    return keyed.rates(keyed.instance_match(expected, predicted, ["checker", "source"]))


@query("batch_rollup", """
SELECT o_custkey, count(*) AS total, sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END)::BIGINT AS done_count,
  CASE WHEN sum(CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END) = count(*) THEN 'done' ELSE 'running' END AS state FROM orders GROUP BY o_custkey""")
def batch_rollup(spark, sf_dir):
    return keyed.batch_rollup(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "P"])


@query("retention", """
SELECT c_custkey, last_use FROM customer LEFT JOIN (SELECT o_custkey, bool_or(o_orderstatus = 'O') AS active, max(o_orderdate) AS last_use FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
WHERE NOT coalesce(active, FALSE) AND (last_use IS NULL OR last_use < TIMESTAMP '1998-01-01')""")
def retention(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderdate")
    return keyed.retention_candidates(table(spark, sf_dir, "customer"), tasks, "c_custkey", F.col("o_orderstatus") == "O", F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00")))


@query("section_words", r"""
WITH l AS (SELECT doc_id, i - 1 AS line, t FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
b AS (SELECT doc_id, line, CASE WHEN length(t) < 60 THEN 1 WHEN length(t) < 120 THEN 2 END AS level, length(regexp_replace(t, '[ \n]', '', 'g')) AS size FROM l),
h AS (SELECT * FROM b WHERE level IS NOT NULL),
e AS (SELECT h.doc_id, h.line, h.level, (SELECT min(x.line) FROM h x WHERE x.doc_id = h.doc_id AND x.line > h.line AND x.level <= h.level) AS fin FROM h)
SELECT e.doc_id, e.line AS heading, e.level, coalesce((SELECT sum(size) FROM b WHERE b.doc_id = e.doc_id AND b.line > e.line AND (e.fin IS NULL OR b.line < e.fin)), 0)::BIGINT AS size FROM e""")
def section_words(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    level = F.when(F.length("t") < 60, 1).when(F.length("t") < 120, 2)
    return keyed.section_sizes(lines.select("doc_id", "line", level.alias("level"), F.length(F.regexp_replace("t", "[ \n]", "")).cast("long").alias("size")), "doc_id", "line", "level", "size")


#: The rule set of the reviews over web pages.
PAGE_RULES = """
id: pages
name: pages
rules:
- {id: R01, type: required_sections, severity: error, params: {sections: [{title: "Th|th"}, {title: "er", min_words: 1500}]}}
- {id: R02, type: word_limit, severity: warning, params: {max_words: 4000}}
- {id: R03, type: page_limit, severity: error, params: {max_pages: 2}}
- {id: R04, type: required_fields, severity: info, params: {fields: [{name: Contact}]}}
"""
_TAG = r"(?is)<(h[1-3]|p|li)(?:\s[^>]*)?>(.*?)</(?:h[1-3]|p|li)>"
_PAGE_SQL = rf"""
WITH b0 AS (SELECT page_id, regexp_extract_all(html, '{_TAG}', 1) AS t, regexp_extract_all(html, '{_TAG}', 2) AS x FROM pages),
b AS (SELECT page_id, i AS ord, lower(t[i]) LIKE 'h%' AS head, CASE WHEN lower(t[i]) LIKE 'h%' THEN substr(t[i], 2, 1)::INT ELSE 0 END AS level,
    trim(regexp_replace(regexp_replace(x[i], '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS txt FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM b0)),
c AS (SELECT *, length(translate(txt, chr(10) || ' ', '')) AS words FROM b),
th AS (SELECT DISTINCT page_id FROM c WHERE head AND (contains(txt, 'Th') OR contains(txt, 'th'))),
er AS (SELECT page_id, arg_min(level, ord) AS level, min(ord) AS ord FROM c WHERE head AND contains(txt, 'er') GROUP BY page_id),
fin AS (SELECT er.page_id, er.ord, min(c.ord) AS fin FROM er LEFT JOIN c ON c.page_id = er.page_id AND c.head AND c.ord > er.ord AND c.level <= er.level GROUP BY ALL),
sec AS (SELECT fin.page_id, coalesce(sum(words), 0) AS n FROM fin LEFT JOIN c ON c.page_id = fin.page_id AND c.ord > fin.ord AND (fin.fin IS NULL OR c.ord < fin.fin) GROUP BY fin.page_id),
tot AS (SELECT page_id, sum(words) AS n, bool_or(regexp_matches(txt, 'Contact\s*[：:]')) AS contact FROM c GROUP BY page_id),
d AS (SELECT p.page_id, (th.page_id IS NULL)::INT + (er.page_id IS NULL OR sec.n < 1500)::INT AS errors, (coalesce(tot.n, 0) > 4000)::INT AS warnings, (NOT coalesce(tot.contact, FALSE))::INT AS infos
  FROM pages p LEFT JOIN th USING (page_id) LEFT JOIN er USING (page_id) LEFT JOIN sec USING (page_id) LEFT JOIN tot USING (page_id))
"""


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ir.from_html(table(spark, sf_dir, "pages"))


@query("review_summary", _PAGE_SQL + """
SELECT page_id::VARCHAR AS doc_id, (errors + warnings + infos)::BIGINT AS total_issues, errors::BIGINT AS errors, warnings::BIGINT AS warnings, infos::BIGINT AS infos, 0::BIGINT AS manual_required_checks, 0::BIGINT AS skipped_checks,
  0::BIGINT AS failed_checks, TRUE AS ai_complete, TRUE AS review_complete, CASE WHEN errors > 0 THEN 'needs_revision' ELSE 'pass' END AS conclusion FROM d""")
def review_summary(spark, sf_dir):
    return review.summary(page_documents(spark, sf_dir), rules.load(PAGE_RULES))


@query("checker_counts", _PAGE_SQL + """
SELECT 'required_sections' AS checker, 'error' AS severity, sum(errors)::BIGINT AS findings FROM d HAVING sum(errors) > 0
UNION ALL SELECT 'word_limit', 'warning', sum(warnings)::BIGINT FROM d HAVING sum(warnings) > 0
UNION ALL SELECT 'required_fields', 'info', sum(infos)::BIGINT FROM d HAVING sum(infos) > 0""")
def checker_counts(spark, sf_dir):
    return review.checker_counts(page_documents(spark, sf_dir), rules.load(PAGE_RULES))


LINE_RULES = """
id: lines
name: lines
rules:
- {id: R01, type: attachment_checklist, severity: error, params: {expected: [licensed under, theth]}}
- {id: R02, type: signature_page, severity: warning, params: {keywords: [tion, license]}}
"""


@query("attachments_and_signatures", """
WITH t AS (SELECT doc_id, array_to_string(string_split(text, chr(10)), ' ') AS x FROM documents),
u AS (SELECT doc_id, x, translate(x, chr(10) || ' ', '') AS h FROM t),
a AS (SELECT doc_id, n FROM u, (VALUES ('licensed under', 'licensedunder'), ('theth', 'theth')) v(n, k)
  WHERE NOT (contains(h, k) OR list_sum(list_transform(string_split(k, ''), lambda c: contains(h, c)::INT)) >= len(k) * 0.7))
SELECT doc_id::VARCHAR AS doc_id, 'R01' AS rule_id, 'error' AS severity, '附件清单中「' || n || '」未在正文中出现' AS message FROM a
UNION ALL SELECT doc_id::VARCHAR, 'R01', 'info', '已找到附件清单文字，但系统无法证明附件文件真实存在' FROM u WHERE doc_id NOT IN (SELECT doc_id FROM a)
UNION ALL SELECT doc_id::VARCHAR, 'R02', CASE WHEN contains(x, 'tion') AND contains(x, 'license') THEN 'info' ELSE 'warning' END,
  CASE WHEN contains(x, 'tion') AND contains(x, 'license') THEN '已找到签字盖章文字，但未检测到可验证的签章图像'
    ELSE '末页缺少签字盖章关键字：{' || array_to_string(list_transform(list_filter(['license', 'tion'], lambda w: NOT contains(x, w)), lambda w: chr(39) || w || chr(39)), ', ') || '}' END FROM u""")
def attachments_and_signatures(spark, sf_dir):
    docs = ir.from_lines(table(spark, sf_dir, "documents"))
    return review.findings(docs, rules.load(LINE_RULES)).select("doc_id", "rule_id", "severity", "message")


@query("rate_limit", """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS at_us, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r(key, at_us, id, n, admitted, times) AS (
  SELECT key, at_us, id, n, TRUE, [at_us] FROM e WHERE n = 1
  UNION ALL
  SELECT e.key, e.at_us, e.id, e.n, len(list_filter(r.times, lambda t: t >= e.at_us - 86400000000)) < 3,
    CASE WHEN len(list_filter(r.times, lambda t: t >= e.at_us - 86400000000)) < 3 THEN list_append(list_filter(r.times, lambda t: t >= e.at_us - 86400000000), e.at_us) ELSE list_filter(r.times, lambda t: t >= e.at_us - 86400000000) END
  FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, at_us, id, admitted FROM r""")
def rate_limit(spark, sf_dir):
    from foliant.streaming.limits import rate_limited

    return rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86_400)


@query("page_status", """
SELECT event_id, CASE WHEN chars = 0 AND images = 0 THEN 'empty' WHEN images > 0 AND chars = 0 THEN 'scanned_no_text' WHEN ratio >= 0.6 AND chars < 200 THEN 'scanned_minimal_text'
  WHEN unread AND ratio >= 0.5 AND chars >= 200 THEN 'mixed_image_unread' ELSE 'ok' END AS status
FROM (SELECT event_id, (event_id % 400)::INT AS chars, (user_id % 3)::INT AS images, (event_id % 10) / 10.0 AS ratio, event_type = 'click' AS unread FROM events)""")
def page_status(spark, sf_dir):
    from foliant.functions.pages import page_status as ladder

    e = table(spark, sf_dir, "events")
    signals = {"digital_chars": (F.col("event_id") % 400).cast("int"), "image_count": (F.col("user_id") % 3).cast("int"), "image_area_ratio": (F.col("event_id") % 10) / 10.0, "has_unread_image_region": F.col("event_type") == "click", "ocr_state": F.lit("not_needed"), "ocr_chars": F.lit(0)}
    return e.select("event_id", ladder(**signals).alias("status"))


STATES = ("success", "insufficient", "failed", "skipped_limit", "not_needed", "not_needed", "not_needed")


@query("page_status_ocr", f"""
WITH e AS (SELECT event_id, {list(STATES)!r}[event_id % 7 + 1] AS state, user_id % 3 AS ocr, (event_id % 400)::INT AS chars, (user_id % 3)::INT AS images, (event_id % 10) / 10.0 AS ratio, event_type = 'click' AS unread FROM events)
SELECT event_id, CASE WHEN state = 'success' THEN CASE WHEN ocr < 2 THEN 'ocr_insufficient' ELSE 'ocr' END WHEN state = 'insufficient' THEN 'ocr_insufficient' WHEN state IN ('failed', 'skipped_limit') THEN 'ocr_' || state
  WHEN chars = 0 AND images = 0 THEN 'empty' WHEN images > 0 AND chars = 0 THEN 'scanned_no_text' WHEN ratio >= 0.6 AND chars < 200 THEN 'scanned_minimal_text' WHEN unread AND ratio >= 0.5 AND chars >= 200 THEN 'mixed_image_unread' ELSE 'ok' END AS status FROM e""")
def page_status_ocr(spark, sf_dir):
    """Pages of every state that character recognition can end in."""
    from foliant.functions.pages import page_status as ladder

    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 7 + 1).cast("int"))
    signals = {"digital_chars": (F.col("event_id") % 400).cast("int"), "image_count": (F.col("user_id") % 3).cast("int"), "image_area_ratio": (F.col("event_id") % 10) / 10.0, "has_unread_image_region": F.col("event_type") == "click", "ocr_state": state, "ocr_chars": F.col("user_id") % 3}
    return table(spark, sf_dir, "events").select("event_id", ladder(**signals, ocr_min_chars=2).alias("status"))


@query("line_sequence_breaks", """
SELECT l_orderkey, before, after FROM (SELECT l_orderkey, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS before, l_linenumber AS after FROM lineitem) WHERE after <> before + 1""")
def line_sequence_breaks(spark, sf_dir):
    """Lines of an order whose numbers are missing or come twice."""
    return keyed.sequence_breaks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("line_classes", r"""
WITH l AS (SELECT doc_id, i - 1 AS line, t FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
s AS (SELECT doc_id, line, length(t) % 3 = 0 AS bold, trim(regexp_replace(t, '^\s+|\s+$', '', 'g')) AS t FROM l)
SELECT doc_id, line, CASE WHEN regexp_full_match(t, '[\d\s\.、\-–—:;,()%]+') THEN 0 WHEN regexp_matches(t, '^\d+\.\d+') THEN 3 WHEN regexp_matches(t, '^\d+[.、](\D|$)') THEN 2 WHEN regexp_matches(t, '^\(\d+\)') THEN 2
  WHEN bold AND length(t) < 30 THEN 2 ELSE 0 END AS level FROM s""")
def line_classes(spark, sf_dir):
    from foliant.functions.derive import classified

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("doc_id", "line", classified(F.col("t"), F.length("t") % 3 == 0, F.lit(14.0), F.lit(12.0))["level"].alias("level"))


@query("greedy_chunks", """
WITH RECURSIVE l AS (SELECT doc_id, i, length(t) AS n FROM (SELECT doc_id, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
r(doc_id, i, chunk, n) AS (
  SELECT doc_id, i, 1, n FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, CASE WHEN r.n + l.n > 2000 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.n + l.n > 2000 THEN l.n ELSE r.n + l.n END FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id, chunk, count(*) AS lines, max(n)::BIGINT AS chars FROM r GROUP BY doc_id, chunk""")
def greedy_chunks(spark, sf_dir):
    from foliant.functions.derive import chunks

    packed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunks(F.split("text", "\n"), F.length, 2000, "string")).alias("chunk", "items"))
    return packed.select("doc_id", (F.col("chunk") + 1).alias("chunk"), F.size("items").cast("long").alias("lines"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("chars"))


@query("evidence_places", """
WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS e FROM benchmark),
d AS (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents)
SELECT item_id, min(doc_id) AS doc_id FROM b JOIN d ON contains(t, e) WHERE e <> '' GROUP BY item_id""")
def evidence_places(spark, sf_dir):
    """The first document that holds each benchmark passage, blanks aside."""
    from foliant.operators.evidence import holding

    pairs = holding(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return pairs.groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))
