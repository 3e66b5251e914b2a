"""Partitions of pages are bounded by their HTML, however small its rows are when they are shuffled."""

import pytest
from pyspark.sql import functions as F

from webquire import queries as Q
from webquire.operators import html as H
from webquire.operators.markdown import convert


@pytest.mark.parametrize("repeats", [1, 4])
def test_partitions_follow_the_bytes(spark, monkeypatch, repeats):
    monkeypatch.setattr(H, "PARTITION_BYTES", 10_000)
    pages = spark.range(40 * repeats).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>é</p>"), 1_000).alias("html"))
    assert H.by_page(pages, "page_id").rdd.getNumPartitions() == 36 * repeats  # 9,000 bytes a page
    assert H.by_page(pages, "page_id", size=123_000).rdd.getNumPartitions() == 13
    assert convert(pages.limit(3).unionByName(spark.createDataFrame([(-1, None)], "page_id long, html string"))).count() == 4


def test_no_page_and_no_html(spark):
    pages = spark.createDataFrame([(1, None)], "page_id long, html string")
    assert [r.text for r in H.html_text(pages).collect()] == [""]
    assert H.html_text(pages.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["html_main_content", "html_strip_tags", "html_text"])
def test_shapes_go_to_the_shuffle_in_small_tasks(spark, tmp_path, monkeypatch, name):
    """One file of 60 pages of 9,000 bytes; what a task hands to the shuffle by key stays near eight partitions' bytes."""
    spark.range(60).select(
        F.col("id").alias("page_id"), F.lit("http://a.test/").alias("url"), F.repeat(F.lit("<p>é</p>"), 1_000).alias("html")
    ).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(H, "PARTITION_BYTES", 45_000)
    handed, by_page = [], H.by_page

    def watched(pages, key, *rest, **more):
        if key == "key":
            sizes = pages.groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("html")).alias("bytes"))
            handed.extend(r["bytes"] for r in sizes.collect())
        return by_page(pages, key, *rest, **more)

    monkeypatch.setattr(H, "by_page", watched)
    Q.QUERIES[name](spark, str(tmp_path))
    assert sum(handed) > 60 * len(Q.SHAPES) * 9_000 - 1 and max(handed) < 4 * len(Q.SHAPES) * H.PARTITION_BYTES
