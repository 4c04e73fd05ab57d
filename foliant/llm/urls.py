"""URL filters (3): rules on host and path first, then a weighted vocabulary of URL terms.

Defined results. Null, or no "://": host and path are empty, no rule fits, and the terms are sought in the whole string (null:
none). Equal rows are judged alike and each returned. An empty table gives an empty result. A vocabulary of one's own is a table of terms, see `vocabulary`.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, lower_az

#: Fixed rules: verdict, host, path from its slash on. The longest that fits wins.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Strict terms reject alone; soft terms reject from MIN_SOFT distinct ones on.
STRICT = ("porn", "xxx", "casino", "viagra", "escort", "hentai", "warez", "cheap-pills", "free-bets", "payday-loans")
SOFT = ("adult", "sex", "bet", "bets", "betting", "poker", "pills", "pharmacy", "loan", "loans", "crack", "torrent", "nude", "cheap", "free", "win", "bonus", "dating", "hot", "deal")
MIN_SOFT = 2
#: Terms of the largest vocabulary (tens of bytes each, so some 20 MB).
MOST_TERMS = 500_000

HITS = "strict_hits long, soft_hits long"


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url, empty for null or without "://"."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.when(there, lower_az(host)).otherwise(""), F.when(there, path).otherwise("")


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null. A tie goes to the first."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for v, h, p in ordered], F.lit(None).cast("struct<verdict:string,rule:string>"))


def automaton(strict: tuple, soft: tuple) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in soft:
        found.add_word(term, (term, False))
    for term in strict:  # a term of both lists is strict
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def hits(url: str | None, terms: ahocorasick.Automaton) -> tuple[int, int]:
    """Distinct strict and soft terms. A term counts where no ASCII letter or digit stands beside it."""
    text = (url or "").translate(_LOWER)
    strict, soft = set(), set()
    for end, (term, is_strict) in terms.iter(text) if len(terms) else ():
        start = end - len(term)
        if (start < 0 or text[start] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            (strict if is_strict else soft).add(term)
    return len(strict), len(soft)


_LOWER = {c: c + 32 for c in range(65, 91)}
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(strict, soft) terms of a table (term, strict), lower-cased; null and empty ones aren't terms.

    A vocabulary is a stated list: it is counted, and one of over `most` terms is refused rather than sent to all workers.
    """
    named = terms.select(lower_az(F.col("term")).alias("term"), "strict").where("term <> ''").groupBy("term").agg(F.max(F.coalesce("strict", F.lit(False))).alias("strict"))
    rows = named.orderBy("term").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a vocabulary of over {most} terms")
    return tuple(r.term for r in rows if r.strict), tuple(r.term for r in rows if not r.strict)


def term_hits(strict: tuple = STRICT, soft: tuple = SOFT):
    """A UDF url -> struct<strict_hits, soft_hits>. The terms are broadcast, and the automaton is built once in a task."""
    terms = SparkSession.active().sparkContext.broadcast((strict, soft))

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sought = automaton(*terms.value)
        for urls in batches:
            yield pd.DataFrame([hits(u, sought) for u in urls], columns=["strict_hits", "soft_hits"], dtype="int64")

    found.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(found, HITS)


def judge(pages: DataFrame, rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """pages with the struct column `url_filter` (or the next free name): host, path, rule, verdict, strict_hits, soft_hits."""
    host, path = parts(F.col("url"))
    name = free_name(pages, "url_filter")
    with_hits = pages.withColumn(name, F.struct(host.alias("host"), path.alias("path"), term_hits(strict, soft)("url").alias("hits")))
    c = lambda x: F.col(f"{name}.{x}")
    rule = rule_of(c("host"), c("path"), rules)
    own = F.when((c("hits.strict_hits") > 0) | (c("hits.soft_hits") >= min_soft), "block").otherwise("allow")
    verdict = F.coalesce(rule["verdict"], own)
    return with_hits.withColumn(name, F.struct(c("host").alias("host"), c("path").alias("path"), rule["rule"].alias("rule"), verdict.alias("verdict"), c("hits.strict_hits").alias("strict_hits"), c("hits.soft_hits").alias("soft_hits")))


def url_query(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "url_filter.*")


def _sql() -> str:
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rule = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest, {lower("coalesce(url, '')")} AS u FROM pages),
b AS (SELECT page_id, u, coalesce({lower("regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, CASE {rule} END AS r, ({" + ".join(map(hit, STRICT))})::BIGINT AS strict_hits, ({" + ".join(map(hit, SOFT))})::BIGINT AS soft_hits FROM b)
SELECT page_id, host, path, split_part(r, ' ', 2) AS rule,
  coalesce(split_part(r, ' ', 1), CASE WHEN strict_hits > 0 OR soft_hits >= {MIN_SOFT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM c
"""


SQL = _sql()
