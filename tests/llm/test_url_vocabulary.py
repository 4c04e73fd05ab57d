"""URL terms from a table of thousands, against a search for each term; clashing names, repeated rows, odd urls."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import urls


def test_vocabulary_of_thousands(spark):
    random.seed(3)
    made = sorted({"".join(random.choice("abc-") for _ in range(random.randint(1, 7))) for _ in range(5000)})
    rows = [(t.upper() if i % 2 else t, i % 9 == 0) for i, t in enumerate(made)] + [(made[1], True), (None, True), ("", False), ("soft", None)]
    strict, soft = urls.vocabulary(spark.createDataFrame(rows, "term string, strict boolean"))
    assert len(strict) + len(soft) == len(made) + 1 and made[1] in strict and "soft" in soft
    given = [None, "", "://", "x" * 100_000] + ["http://e.org/" + "".join(random.choice("abcABC-/1é") for _ in range(40)) for _ in range(60)]
    pages = spark.createDataFrame([(i, u, "mine", 1) for i, u in enumerate(given)] + [(4, given[4], "mine", 1)], "page_id long, url string, url_filter string, `a.b` int")
    out = urls.judge(pages, (), strict, soft, 3)
    assert out.columns == [*pages.columns, "url_filter1"] and out.count() == len(given) + 1
    inside = lambda t, u: re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", u)
    for r in out.select("url", "url_filter", "url_filter1.*").collect():
        u = re.sub("[A-Z]", lambda m: m.group().lower(), r.url or "")
        hits = sum(bool(inside(t, u)) for t in strict), sum(bool(inside(t, u)) for t in soft)
        assert (r.strict_hits, r.soft_hits) == hits and r.verdict == ("block" if hits[0] or hits[1] >= 3 else "allow")


def test_bounds_of_a_vocabulary(spark):
    terms = spark.range(20).select(F.concat(F.lit("t"), "id").alias("term"), F.lit(False).alias("strict"))
    with pytest.raises(ValueError, match="over 19 terms"):
        urls.vocabulary(terms, 19)
    pages = spark.createDataFrame([(1, "http://t1.org")], "page_id long, url string")
    assert urls.vocabulary(terms.limit(0)) == ((), ()) and urls.judge(pages, (), (), ()).first().url_filter.verdict == "allow"
