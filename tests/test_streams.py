"""The streaming queries over a table that is one file and over one that is a folder of files."""

import pytest

from webquire.queries import QUERIES

PAGES = [(i, f"https://s.test/d/{i}", f'<html><body><article><p>page {i}</p></article><a href="/d/{i % 3}">x</a></body></html>') for i in range(12)]


@pytest.fixture(params=["file", "folder"])
def tables(request, spark, tmp_path):
    frame, place = spark.createDataFrame(PAGES, "page_id long, url string, html string"), tmp_path / "pages.parquet"
    if request.param == "folder":
        frame.repartition(3).write.parquet(str(place))
    else:
        frame.toPandas().to_parquet(place)
    return str(tmp_path)


def test_every_page_arrives(spark, tables):
    converted = QUERIES["stream_converted"](spark, tables).collect()
    assert sorted((r.page_id, r.markdown, r.status) for r in converted) == [(i, f"page {i}\n", "ok") for i, _, _ in PAGES]
    for name in ("stream_first_links", "stream_recent_links"):
        assert sorted(r.dst_url for r in QUERIES[name](spark, tables).collect()) == [f"https://s.test/d/{i}" for i in range(3)]
