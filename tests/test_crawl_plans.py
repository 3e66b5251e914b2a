"""What a crawl shuffles and opens, level by level."""

import re

from pyspark.sql import functions as F

from webquire.plans import crawl as C


def chain(spark, n):
    """Page ``i`` points to the next one, back to the first, and out of scope."""
    url = lambda i: F.concat(F.lit("http://a.test/p"), i.cast("string"))
    html = F.concat(F.lit('<a href="'), url(F.col("id") + 1), F.lit('">x</a><a href="/p0">y</a><a href="http://b.test/">z</a>'))
    return spark.range(n).select(F.when(F.col("id") == 0, "http://a.test/").otherwise(url(F.col("id"))).alias("url"), html.alias("html"))


def test_fifty_levels_shuffle_only_what_they_find(spark, monkeypatch):
    plans, level = [], C.next_level

    def recorded(found, visited):
        out = level(found, visited)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "next_level", recorded)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = C.crawl(chain(spark, 50), "http://a.test/").orderBy("crawl_order").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert [(r.depth, r.status) for r in got if r.url != "http://a.test/p0"] == [(0, "ok"), *((i, "ok") for i in range(1, 50)), (50, "error")]
    assert len(plans) >= 50
    for plan in plans:
        # the targets by URL and the new ones in order: neither edges nor earlier levels move
        assert sorted(re.findall(r"Exchange (\w+)", plan)) == ["hashpartitioning", "rangepartitioning"], plan
        assert plan.count("Bucketed: true") == 3


def test_a_budget_opens_the_files_of_its_pages_alone(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    chain(spark, 60).repartitionByRange(20, "url").write.parquet(store)
    pages = spark.read.parquet(store)
    located, opened = C.located, []

    def recorded(*args, **columns):
        out = located(*args, **columns)
        out.collect()
        plan, scans = out._jdf.queryExecution().executedPlan(), []
        plan = plan.executedPlan() if "Adaptive" in plan.nodeName() else plan
        leaves = plan.collectLeaves()
        for i in range(leaves.size()):
            if leaves.apply(i).nodeName().startswith("Scan") and "html" in leaves.apply(i).toString():
                scans.append(leaves.apply(i).metrics().apply("numFiles").value())
        opened.append(scans)
        return out

    monkeypatch.setattr(C, "located", recorded)
    got = C.crawl(pages, "http://a.test/", max_pages=4)
    assert {(r.url, r.status) for r in got.collect()} == {("http://a.test/", "ok"), ("http://a.test/p0", "error"), ("http://a.test/p1", "ok"), ("http://a.test/p2", "ok")}
    assert len(spark.read.parquet(store).inputFiles()) == 20
    assert opened and all(n <= 1 for scans in opened[:-1] for n in scans) and all(n <= 3 for n in opened[-1])
    places = C.locator(pages, F.col("url").startswith("http://a.test"))
    assert "ReadSchema: struct<url:string>" in places._jdf.queryExecution().executedPlan().toString()


def test_a_store_without_files_has_the_same_crawl(spark, tmp_path):
    pages = chain(spark, 12).union(chain(spark, 3))
    pages.write.parquet(str(tmp_path / "store"))
    expected = [tuple(r) for r in C.crawl(pages.cache(), "http://a.test/", max_pages=6).orderBy("crawl_order").collect()]
    assert expected == [tuple(r) for r in C.crawl(spark.read.parquet(str(tmp_path / "store")), "http://a.test/", max_pages=6).orderBy("crawl_order").collect()]
    assert len(expected) == 6


def test_a_store_may_have_columns_of_any_name(spark, tmp_path):
    names = ["seq", "parent", "raw", "file", "base", "depth", "has_html", "redirect", "pos"]
    chain(spark, 5).select("*", *(F.lit("x").alias(c) for c in names)).write.parquet(str(tmp_path / "store"))
    pages = spark.read.parquet(str(tmp_path / "store"))
    assert C.crawl(pages, "http://a.test/", max_pages=4).count() == 4 and C.crawl(pages, "http://a.test/").count() == 7
