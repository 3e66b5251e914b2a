"""The crawl of a stream: pages in any order end in the crawl's result."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from webquire import queries
from webquire.plans.crawl import crawl
from webquire.streaming.streams import _meet, discovered, stream_discovery

SEED = "https://s.test/d"


def url(i):
    return SEED + (f"/{i}" if i else "")


def graph(rnd, n):
    """Random links, some to missing pages and out of scope; a page without HTML; a long way and a short one to a page."""
    rows = [(url(i), "".join(f'<a href="{url(rnd.randrange(n + 3))}">x</a>' for _ in range(rnd.randint(0, 2))) + f'<a href="{url(i + 1)}">n</a><a href="/e">o</a>', None) for i in range(n)]
    return [*rows, (url(n), None, "gone"), (url(900), f'<a href="{url(901)}">never reached</a>', None)]


def test_pages_in_any_order(spark, tmp_path):
    rnd = random.Random(2)
    rows = graph(rnd, 6)
    schema = "url string, html string, error string"
    expected = {tuple(r) for r in crawl(spark.createDataFrame(rows, schema), SEED, error="error").select("url", "depth", "status", "error").collect()}
    rnd.shuffle(rows)
    store, out, state = (str(tmp_path / c) for c in ("store", "out", "state"))
    for k in (0, 1):  # the second half comes after the query has been stopped
        spark.createDataFrame(rows[k::2], schema).coalesce(2).write.mode("append").parquet(store)
        pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(store)
        query = stream_discovery(pages, SEED, out, state, error="error")
        query.processAllAvailable()
        query.stop()
    assert {tuple(r) for r in discovered(spark, out).collect()} == expected
    assert {u for u, *_ in expected}.isdisjoint({url(900), url(901)})


def test_an_unreached_page_is_forgotten_in_time():
    """A state of its own: the page comes, nothing points to it in time, then something does."""

    class State:
        def __init__(self):
            self.value, self.exists, self.hasTimedOut, self.wait = None, False, False, None

        get = property(lambda self: self.value)

        def update(self, value):
            self.value, self.exists = value, True

        def remove(self):
            self.value, self.exists, self.hasTimedOut = None, False, False

        def setTimeoutDuration(self, ms):
            self.wait = ms

    def message(links, ok, depth):
        return pd.DataFrame([("u", links, ok, None, depth)], columns=["url", "links", "ok", "stored_error", "depth"])

    state = State()
    assert list(_meet(("u",), iter([message(["v"], True, None)]), state, 50)) == [] and state.wait == 50
    state.hasTimedOut = True
    assert list(_meet(("u",), iter([]), state, 50)) == [] and not state.exists
    (late,) = _meet(("u",), iter([message(None, None, 3)]), state, 50)
    assert late[["url", "depth", "fetched"]].values.tolist() == [["u", 3, False]]
    (again,) = _meet(("u",), iter([message(["v", "w"], True, None)]), state, 50)
    assert again[["url", "depth"]].values.tolist() == [["u", 3], ["v", 4], ["w", 4]]
    assert list(_meet(("u",), iter([message(None, None, 5)]), state, 50)) == []
    (sooner,) = _meet(("u",), iter([message(None, None, 1)]), state, 50)
    assert sooner[["url", "depth"]].values.tolist() == [["u", 1], ["v", 2], ["w", 2]]


def test_an_invalid_seed_is_refused(spark, tmp_path):
    pages = spark.readStream.schema("url string, html string").parquet(str(tmp_path))
    with pytest.raises(ValueError, match="invalid seed"):
        stream_discovery(pages, "/no-host", str(tmp_path / "out"), str(tmp_path / "state"))


def test_a_message_is_cheap():
    """Every URL of a crawl is a call or more; 2,000 took 6 s when pandas inferred and cast the types of every answer."""

    class Reached:
        exists, hasTimedOut, get = True, False, (None, ["v", "w"], True, None)

        def update(self, value):
            pass

    told = pd.DataFrame([("u", None, None, None, 3)], columns=["url", "links", "ok", "stored_error", "depth"])
    began = time.process_time()
    for _ in range(2_000):
        (news,) = _meet(("u",), iter([told]), Reached(), None)
    assert time.process_time() - began < 2
    assert news.values.tolist() == [["u", 3, True, True, None], ["v", 4, None, None, None], ["w", 4, None, None, None]]


def test_files_of_the_stream_keep_their_size(spark, tmp_path, monkeypatch):
    """More bytes of HTML are more files, not larger ones, and still come in three arrivals."""
    rows = [(i, f"https://s.test/{i}", f"<html>{i}{'x' * 1_000}</html>") for i in range(60)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(queries, "FILE_BYTES", 5_000)
    stores, named = [], queries.work_path

    def kept(spark, name):
        path = named(spark, name)
        stores.extend([path] if name == "arriving" else [])
        return path

    monkeypatch.setattr(queries, "work_path", kept)
    found = {(r.url, r.status) for r in queries.stream_discovered(spark, str(tmp_path)).collect()}
    assert {u for u, s in found if s == "ok"} == {queries.SEED + (f"/{i}" if i else "") for i in range(60)}
    files = spark.read.parquet(stores[0]).select(F.input_file_name().alias("f")).distinct().count()
    assert 12 < files <= 18
