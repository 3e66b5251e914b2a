"""Breadth-first crawl of a page store.

Without a page budget the store's HTML is parsed once: what the pages in scope are and where they point is written as
narrow tables, and the levels work on those alone.  With a budget only reached pages are parsed; a locator, made from
the store's URLs alone, says in which file a URL's page stands, so a level opens only the files of its own pages.

Edges, locator and visited URLs are tables in hash buckets by URL.  A level joins and anti-joins them bucket by bucket,
so what is shuffled are the targets that the level finds, never the edges or the levels before.  Each level is appended
to the visited table in the shared folder, so lineage stays flat and lost executors cost one level at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquire.functions.urls import in_scope, is_http, normalize_url
from webquire.operators.links import dedup_first, frontier_lookup, link_table, normal_seed, page_links, store_status, unvisited, with_status
from webquire.operators.ranking import nth_row_id, partition_sizes, ranked
from webquire.operators.report import report_items
from webquire.session import cut, work_path

# the file that a row of the store is read from; hidden in tables read from files, unknown in others
FILE = "_metadata.file_path"


class Buckets:
    """A table in hash buckets by ``url``, in the shared folder: joins on ``url`` between such tables need no shuffle.

    There are as many buckets as shuffle partitions, so rows that are shuffled by ``url`` meet them as they are.
    """

    def __init__(self, spark: SparkSession, name: str, partition: str | None = None) -> None:
        self.spark, self.path, self.partition = spark, work_path(spark, name), partition
        self.table, self.n = f"webquire_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def append(self, rows: DataFrame) -> None:
        """A bucket gets one file, sorted by ``url``."""
        writer = rows.repartition(self.n, "url").sortWithinPartitions("url").write.format("parquet").option("path", self.path)
        writer = writer.partitionBy(self.partition) if self.partition else writer
        writer.bucketBy(self.n, "url").sortBy("url").mode("append").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def forget(self) -> None:
        """Drop the name; the files stay for results that read them."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def seeds(spark: SparkSession, urls: Sequence[str] | DataFrame, url: str = "url") -> DataFrame:
    """``(url, pos)``: normalised start set, invalid ones out, the first of duplicates kept.

    Takes a Python list or a DataFrame with ``url`` and ``pos`` (a retry list).
    """
    if not isinstance(urls, DataFrame):
        urls = spark.createDataFrame(list(enumerate(urls)), "pos bigint, url string")
    named = urls.select(normalize_url(url).alias("url"), "pos").filter(F.col("url").isNotNull())
    return dedup_first(named, "url", "pos")


def locator(pages: DataFrame, within: Column, url: str = "url") -> DataFrame:
    """``(url, raw, file)`` of the store's rows whose normalised URL is ``within``: only URLs are read, no HTML.

    ``raw`` is the URL as stored.  ``file`` is NULL if the store's rows do not come from files.
    """
    file = F.col(FILE) if _knows_files(pages) else F.lit(None).cast("string")
    return pages.select(normalize_url(url).alias("url"), F.col(url).alias("raw"), file.alias("file")).filter(within)


def _knows_files(pages: DataFrame) -> bool:
    try:
        pages.select(FILE).schema
    except AnalysisException:
        return False
    return True


def located(pages: DataFrame, spots: DataFrame, url: str = "url", **columns: Column) -> DataFrame:
    """The ``columns`` of the store's rows that the written ``spots`` (``raw, file`` and others) name, with those others.

    Only the files named are opened.  Their names pass through the driver, at most one per row of ``spots``.
    """
    files = [r["file"] for r in spots.select("file").distinct().collect()]
    if files and None not in files:
        pages = pages.filter(F.col(FILE).isin(files))
    rows = pages.select(F.col(url).alias("raw"), *(c.alias(name) for name, c in columns.items()))
    return rows.join(spots.drop("file").distinct(), "raw").drop("raw")


def next_level(found: DataFrame, visited: DataFrame) -> DataFrame:
    """``(url, seq)`` of the targets in ``found`` (``url, parent, pos``) that are new, in the order of their discovery.

    The sorted row id keeps the order of the level; the next level refers to it.
    """
    first = found.groupBy("url").agg(F.min(F.struct("parent", "pos")).alias("first"))
    return unvisited(first, visited, link="url").orderBy("first").select("url", F.monotonically_increasing_id().alias("seq"))


def targets(front: DataFrame, edges: DataFrame) -> DataFrame:
    """``(url, parent, pos)``: where the pages of ``front`` (``url, seq``) point; ``edges`` has ``url, dst_url, pos``."""
    return front.join(edges, "url").select(F.col("dst_url").alias("url"), F.col("seq").alias("parent"), "pos")


def crawl(
    pages: DataFrame,
    seed: str,
    max_pages: int = 0,
    max_depth: int | None = None,
    url: str = "url",
    html: str = "html",
    final_url: str | None = None,
    error: str | None = None,
) -> DataFrame:
    """``(url, depth, crawl_order, status, error)`` of a first-in-first-out walk from ``seed``.

    ``max_pages`` counts error rows too; 0 or less means no cap.  A page missing from the
    store is an error row and a leaf.  Inside a level the order is (order of the
    discovering page, position of the link).  The store should hold one row per URL.
    """
    spark = pages.sparkSession
    base = normal_seed(spark, seed)
    if base is None:
        raise ValueError(f"invalid seed: {seed}")
    reachable = in_scope(F.lit(base), F.col("url")) & is_http("url")
    budget = max_pages > 0
    walked, known = Buckets(spark, "walked", "depth"), Buckets(spark, "places" if budget else "edges")
    try:
        if budget:
            known.append(locator(pages, reachable, url))
            links, redirect = page_links("html", "base"), F.col(final_url) if final_url else F.lit(None).cast("string")

            def found_from(front: DataFrame) -> DataFrame:
                spots = cut(front.withColumnRenamed("seq", "parent").join(known.rows(), "url"), "spots")
                here = located(pages, spots, url, html=F.col(html), redirect=redirect).filter(F.col("html").isNotNull())
                here = here.select("parent", F.coalesce("redirect", "url").alias("base"), "html")
                return here.select("parent", F.posexplode_outer(links).alias("pos", "url")).filter(F.col("pos").isNotNull()).filter(reachable)

        else:
            # only pages of the seed's own scope can be reached, so only their HTML is parsed
            inside = pages.withColumn("_url", normalize_url(url)).filter(in_scope(F.lit(base), F.col("_url")) & is_http("_url")).drop("_url")
            graph = cut(link_table(inside, url, html, final_url, error), "graph")
            out = graph.select(F.col("url").alias("src_url"), F.posexplode_outer("links").alias("pos", "url")).filter(F.col("pos").isNotNull())
            edges = out.filter(reachable).groupBy("src_url", "url").agg(F.min("pos").alias("pos"))
            known.append(edges.select(F.col("src_url").alias("url"), F.col("url").alias("dst_url"), "pos"))

            def found_from(front: DataFrame) -> DataFrame:
                return targets(front, known.rows())

        walked.append(spark.range(1).select(F.lit(base).alias("url"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("depth")))
        depth, used, last_seq = 0, 1, None
        while not (budget and used >= max_pages) and (max_depth is None or depth < max_depth):
            front = walked.rows().filter(F.col("depth") == depth).select("url", "seq")
            depth += 1
            walked.append(next_level(found_from(front), walked.rows().select("url")).withColumn("depth", F.lit(depth)))
            sizes = partition_sizes(walked.rows().filter(F.col("depth") == depth), "seq")
            size = sum(sizes.values())
            if budget and used + size > max_pages:
                last_seq = nth_row_id(sizes, max_pages - used)
            used += size
            if not size:
                break
        visited = walked.rows()
        if last_seq is not None:
            visited = visited.filter((F.col("depth") < depth) | (F.col("seq") <= last_seq))
        order = ranked(visited.select("url", "depth", "seq"), "depth", "seq", name="walk").df.withColumnRenamed("rank", "crawl_order")
        order = order.select("url", "depth", "crawl_order")
        if not budget:
            return with_status(order, store_status(graph, "url", "has_html", "stored_error", normal=True))
        spots = cut(order.select("url").join(known.rows(), "url"), "spots")
        stored = F.col(error) if error else F.lit(None).cast("string")
        here = located(pages, spots, url, has_html=F.col(html).isNotNull(), stored_error=stored)
        return with_status(order, store_status(here, "url", "has_html", "stored_error", normal=True))
    finally:
        walked.forget()
        known.forget()


def retry_report(pages: DataFrame, reports: DataFrame, step: str = "crawl", max_pages: int = 0, url: str = "url", html: str = "html", error: str | None = None) -> DataFrame:
    """Fetch again what a report lists as failed in ``step``, in URL order; ``crawl_retry``'s columns.

    The step's items are URLs; those of the convert step are file names, which ``plans.build.retry_convert`` takes.
    """
    if step == "convert":
        raise ValueError("the convert step lists file names: use retry_convert")
    failed = report_items(reports).filter((F.col("step") == step) & (F.col("status") == "error"))
    return crawl_retry(pages, failed.select("url", F.col("url").alias("pos")), max_pages, url, html, error)


def crawl_retry(
    pages: DataFrame, urls: Sequence[str] | DataFrame, max_pages: int = 0, url: str = "url", html: str = "html", error: str | None = None
) -> DataFrame:
    """Fetch the given URLs again: one level, no links followed, no scope check."""
    start = ranked(seeds(pages.sparkSession, urls), "pos", name="retry")
    kept = start.df.filter(F.col("rank") <= max_pages) if max_pages > 0 else start.df
    level = kept.select("url", F.lit(0).alias("depth"), F.col("rank").alias("crawl_order"))
    return frontier_lookup(level, pages, url, html, error)
