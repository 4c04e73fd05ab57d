"""Quality rules (2): rules on each document, and verdicts on hosts from the failures of all their documents.

Defined results. Null or empty text: no words, so all counts are 0 and base_failed is true. A null source is a host of its
own. Equal rows are judged alike and each returned. An empty table gives an empty result. Columns beside doc_id, text and
source stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, key_of, kept_table, lookup, small_batches, typed

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT, SYMBOLS = 20, 8, 30, "#*$%&|<>"
#: Soft rules: they count for the host, and drop a document only on a host with a bad verdict.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_WORDS, MIN_WORD_CHARS, MAX_WORD_CHARS = 10, 20, 2, 14
#: A host is bad if its shrunk rate of failed documents is above this.
MAX_HOST_RATE = 0.5

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(codes: np.ndarray) -> int:
    """Positions that windows found twice or more cover. Hashes find equal windows, and the words themselves confirm them."""
    n = len(codes) - WINDOW + 1
    if n < 2:
        return 0
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h += mixed[j : j + n] * _FACTORS[j]
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if all((codes[a + j] == codes[b + j]).all() for j in range(WINDOW)):
        starts = np.concatenate([a, b])
    else:  # two different windows share a hash
        seen: dict[bytes, list[int]] = {}
        for i in range(n):
            seen.setdefault(codes[i : i + WINDOW].tobytes(), []).append(i)
        starts = np.array([i for x in seen.values() if len(x) > 1 for i in x], np.int64)
    covered = np.zeros(len(codes), bool)
    for j in range(WINDOW):
        covered[starts + j] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()  # bytes.split() parts at the six ASCII white-space characters
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(codes) if len(number) < len(words) else 0,
    )


@F.pandas_udf(typed(MEASURES))
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=[x.split()[0] for x in MEASURES.split(", ")], dtype="int64")


def base_failed(m: str) -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{m}.n_words"))


def soft_failed(m: str) -> Column:
    c = lambda x: F.col(f"{m}.{x}")
    return (100 * c("n_symbols") > MAX_SYMBOL_PERCENT * c("n_words")) | (c("n_dup_lines") > MAX_DUP_LINE_WORDS) | (c("word_chars") < MIN_WORD_CHARS * c("n_words")) | (c("word_chars") > MAX_WORD_CHARS * c("n_words"))


def host_verdicts(measured: DataFrame, host: str, m: str) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_bad.

    The beta prior comes from the hosts: their mean failure rate, and a strength by the method of moments from its variance
    over hosts (both weigh hosts by documents).
    """
    hosts = kept_table(measured.groupBy(host).agg(F.count("*").alias("host_docs"), F.sum((base_failed(m) | soft_failed(m)).cast("long")).alias("host_failed")), "hosts")
    rate = F.col("host_failed") / F.col("host_docs")
    a = hosts.agg(F.sum("host_docs").alias("n"), F.sum("host_failed").alias("k"), F.sum(rate * rate * F.col("host_docs")).alias("q")).first()
    n, k, q = a.n or 0, a.k or 0, a.q or 0.0
    mean = min(max(k / n, 1e-6), 1 - 1e-6) if n else 0.5
    variance = max(q / n - (k / n) ** 2, 0.0) if n else 0.0
    strength = min(max(mean * (1 - mean) / variance - 1, 1.0), 1e6) if variance > 0 else 1e6
    shrunk = (F.col("host_failed") + mean * strength) / (F.col("host_docs") + strength)
    return hosts.withColumn("host_rate", F.round(shrunk, 6)).withColumn("host_bad", F.col("host_rate") > MAX_HOST_RATE)


def with_verdicts(measured: DataFrame, named: DataFrame, columns: list[str], m: str, host: str, spread: Column) -> DataFrame:
    """The columns and the struct `quality` (or the next free name) of rows with their measures m and their host."""
    h = named.columns[-1]
    whole = lookup(measured, named, host, spread=spread)
    kept = ~base_failed(m) & ~(F.col(f"{h}.host_bad") & soft_failed(m))
    quality = F.struct(f"{m}.*", base_failed(m).alias("base_failed"), kept.alias("kept"), soft_failed(m).alias("soft_failed"), f"{h}.*")
    return whole.select(*[F.col(f"`{c}`") for c in columns], quality.alias(free_name(whole.select(*[F.col(f"`{c}`") for c in columns]), "quality")))


def judge(docs: DataFrame) -> DataFrame:
    """docs with the struct column `quality` (or the next free name): the measures, base_failed, host figures and kept.

    Documents are kept with their measures, which both the hosts and the verdicts are made from: a verdict's filter would otherwise be
    pushed below the measures, and each text be measured once more for it. Texts are never shuffled.
    """
    small_batches(docs.sparkSession)
    m, host = free_name(docs, "measured"), free_name(docs, "host")
    measured = kept_table(docs.withColumn(m, measures("text")).withColumn(host, key_of(F.col("source"))), "measured")
    named = host_verdicts(measured, host, m).select(host, F.struct("host_docs", "host_failed", "host_rate", "host_bad").alias(free_name(docs, "verdict")))
    return with_verdicts(measured, named, docs.columns, m, host, F.monotonically_increasing_id())


def quality_query(docs: DataFrame) -> DataFrame:
    """The result has no text, so the texts are read once and their measures kept."""
    small_batches(docs.sparkSession)
    measured = kept_table(docs.select("doc_id", measures("text").alias("measured"), key_of(F.col("source")).alias("host")), "measures")
    named = host_verdicts(measured, "host", "measured").select("host", F.struct("host_docs", "host_failed", "host_rate", "host_bad").alias("verdict"))
    judged = with_verdicts(measured, named, ["doc_id"], "measured", "host", F.monotonically_increasing_id())
    c = [F.col(f"quality.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_docs", "host_failed", "host_rate")]
    return judged.select("doc_id", *c)


def keep_good(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that are kept, with their own columns."""
    return judge(docs).where(F.col(f"{free_name(docs, 'quality')}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rowid_, doc_id, text, source FROM documents
), words AS (
  SELECT rowid_ AS r, i, w FROM (
    SELECT rowid_, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
    FROM (SELECT rowid_, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM d))
), win AS (
  SELECT r, i, lead(i, 7) OVER o AS ok,
    concat_ws(chr(31), w, {", ".join(f"lead(w, {j}) OVER o" for j in range(1, 8))}) AS k
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win WHERE ok IS NOT NULL) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT i + j) AS n FROM dup, range(8) t(j) GROUP BY r
), lines AS (
  SELECT rowid_ AS r, count(*) - count(DISTINCT l) AS n FROM (SELECT rowid_, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rowid_
), m AS (
  SELECT d.doc_id, coalesce('v' || source, 'n') AS host,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
    length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines ON lines.r = rowid_ LEFT JOIN rep ON rep.r = rowid_
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    100 * n_symbols > {MAX_SYMBOL_PERCENT} * n_words OR n_dup_lines > {MAX_DUP_LINE_WORDS} OR word_chars < {MIN_WORD_CHARS} * n_words OR word_chars > {MAX_WORD_CHARS} * n_words AS soft_failed
  FROM m
), h AS (
  SELECT host, count(*) AS host_docs, sum((base_failed OR soft_failed)::INT)::BIGINT AS host_failed FROM f GROUP BY host
), p AS (
  SELECT greatest(least(sum(host_failed) / sum(host_docs), 1 - 1e-6), 1e-6) AS mean,
    greatest(sum(host_failed * host_failed / host_docs) / sum(host_docs) - pow(sum(host_failed) / sum(host_docs), 2), 0) AS v FROM h
), s AS (
  SELECT mean, CASE WHEN v > 0 THEN least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM p
), g AS (
  SELECT host, host_docs, host_failed, round((host_failed + mean * strength) / (host_docs + strength), 6) AS host_rate FROM h, s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rate > {MAX_HOST_RATE} AND soft_failed) AS kept, soft_failed, host_docs, host_failed, host_rate
FROM f JOIN g USING (host)
"""
