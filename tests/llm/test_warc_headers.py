"""Records with very long headers, and a query that never leaves out a page silently."""

import pytest

from foliant.llm import warc


def long_urls(spark):
    urls = ["http://h/" + "u" * n for n in (70_000, 10, 300_000)] + [None]
    return spark.createDataFrame([(i, u, "<p>same</p>" if i < 2 else f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1), urls


@pytest.mark.parametrize("gzip", [True, False])
def test_long_urls_round_trip(spark, gzip):
    df, urls = long_urls(spark)
    rows = warc.read(warc.write(df, gzip=gzip)).collect()
    assert {r.page_id: (r.kind, r.url) for r in rows} == {i: ("record", u) for i, u in enumerate(urls)}


def test_query_has_every_page_or_fails(spark, monkeypatch):
    df, urls = long_urls(spark)
    assert {(r.page_id, r.refers_to) for r in warc.warc_query(df).collect()} == {(0, None), (1, 0), (2, None), (3, None)}
    write = warc.write

    def damaged(pages):
        archives = write(pages)
        path = archives.first().path.removeprefix("file:")
        with open(path, "r+b") as f:
            f.write(b"junk")
        return archives

    monkeypatch.setattr(warc, "write", damaged)
    with pytest.raises(RuntimeError, match="records written"):
        warc.warc_query(df).collect()
