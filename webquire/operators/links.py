"""Link extraction and the frontier operators of a crawl."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webquire.functions.text import ColumnOrName, _col, by_name
from webquire.functions.urls import cache_key, in_scope, is_http, let, normalize_url, resolve_href
from webquire.operators.html import WS, attribute, token_array
from webquire.session import cut


@by_name
def page_links(html: ColumnOrName, base: ColumnOrName) -> Column:
    """Array of the distinct absolute links of one page, in document order.

    Row-local: neither the tokens nor the links of a page are shuffled.
    """
    html, base = _col(html), _col(base)
    openers = F.filter(token_array(html), lambda t: t.rlike(rf"(?i)^<(?:a|link)[{WS}/>]") & t.endswith(">"))
    hrefs = F.array_distinct(F.filter(F.transform(openers, lambda t: attribute(t, "href")), lambda h: h != ""))

    def resolved(b: Column) -> Column:
        return F.array_compact(F.transform(hrefs, lambda h: resolve_href(b, h)))

    return F.array_distinct(let(base, resolved))


def extract_links(
    pages: DataFrame, url: str = "url", html: str = "html", final_url: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``(src_url, dst_url, pos, *keep)``: one row per distinct link of a page.

    ``src_url`` is the page's normalised URL; links resolve against ``final_url``
    where it is set.  ``pos`` counts the page's distinct links from 0.
    """
    normal = normalize_url(url)
    base = F.coalesce(F.col(final_url), normal) if final_url else normal
    return (
        pages.filter(F.col(html).isNotNull())
        .select(normal.alias("src_url"), base.alias("base"), F.col(html).alias("html"), *keep)
        .filter(F.col("src_url").isNotNull())
        # the outer form, because the inner one makes the optimizer evaluate the array three times
        .select("src_url", F.posexplode_outer(page_links("html", "base")).alias("pos", "dst_url"), *keep)
        .filter(F.col("pos").isNotNull())
        .select("src_url", "dst_url", "pos", *keep)
    )


def dedup_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Smallest ``order`` of each key; combines map-side before the shuffle."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html", final_url: str | None = None) -> DataFrame:
    """Whole-graph edge list ``(src_url, dst_url, pos, in_store)``.

    The store's URLs are written first: with a plain table on that side, adaptive
    execution can split the links to a target that most pages point to.
    """
    links = extract_links(pages, url, html, final_url)
    known = pages.select(normalize_url(url).alias("dst_url")).filter(F.col("dst_url").isNotNull()).distinct()
    stored = cut(known, "stored").withColumn("in_store", F.lit(True))
    return links.join(stored, "dst_url", "left").select(
        "src_url", "dst_url", "pos", F.coalesce("in_store", F.lit(False)).alias("in_store")
    )


def unvisited(links: DataFrame, visited: DataFrame, link: str = "dst_url", seen: str = "url") -> DataFrame:
    """Links whose target is not among the visited URLs."""
    return links.join(visited.select(F.col(seen).alias(link)), link, "left_anti").select(links.columns)


def normal_seed(spark: SparkSession, seed: str) -> str | None:
    """The seed in normal form, as a plain string: one value, made without a job."""
    return spark.sql("SELECT 1").select(normalize_url(F.lit(seed))).head()[0]


def scope_filter(links: DataFrame, seed: str, link: str = "dst_url") -> DataFrame:
    """HTTP links inside the seed's scope (always the seed's, not the parent page's).

    The seed enters as a literal, so its host and path prefix are folded to constants.
    """
    base = normal_seed(links.sparkSession, seed)
    return links.filter(in_scope(F.lit(base).cast("string"), F.col(link)) & is_http(link))


def store_status(pages: DataFrame, url: str = "url", html: str = "html", error: str | None = None, normal: bool = False) -> DataFrame:
    """``(url, has_html, stored_error)`` of each normalised URL of the store: narrow, HTML stays behind.

    ``normal``: ``pages`` is a ``link_table``, whose URLs are normal and whose ``html`` is a boolean.
    """
    stored = F.col(error) if error else F.lit(None).cast("string")
    has = F.col(html) if normal else F.col(html).isNotNull()
    return (
        pages.select((F.col(url) if normal else normalize_url(url)).alias("url"), has.alias("has_html"), stored.alias("stored_error"))
        .filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max("has_html").alias("has_html"), F.min("stored_error").alias("stored_error"))
    )


def link_table(pages: DataFrame, url: str = "url", html: str = "html", final_url: str | None = None, error: str | None = None) -> DataFrame:
    """``(url, has_html, stored_error, links)``: all that a crawl needs of a page, one row per store row."""
    normal = normalize_url(url)
    base = F.coalesce(F.col(final_url), normal) if final_url else normal
    stored = F.col(error) if error else F.lit(None).cast("string")
    rows = pages.select(normal.alias("url"), F.col(html).isNotNull().alias("has_html"), stored.alias("stored_error"), base.alias("_base"), F.col(html).alias("_html"))
    return rows.filter(F.col("url").isNotNull()).select("url", "has_html", "stored_error", F.when(F.col("has_html"), page_links("_html", "_base")).alias("links"))


def frontier_lookup(
    frontier: DataFrame, pages: DataFrame, url: str = "url", html: str = "html", error: str | None = None
) -> DataFrame:
    """Outcome of each frontier URL against the page store: ``ok`` or ``error``.

    A page without HTML keeps the error that the store holds for it, if ``error`` names the column.
    """
    return with_status(frontier, store_status(pages, url, html, error))


def with_status(frontier: DataFrame, status: DataFrame) -> DataFrame:
    """Outcome of each frontier URL by ``store_status``."""
    found = frontier.join(status, "url", "left")
    ok = F.coalesce("has_html", F.lit(False))
    reason = F.when(F.col("has_html").isNull(), "not in page store").otherwise(F.coalesce("stored_error", F.lit("page has no html")))
    return found.select(
        *frontier.columns,
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, reason).alias("error"),
    )


def cache_hits(urls: DataFrame, cache: DataFrame, url: str = "url", key: str = "cache_key") -> DataFrame:
    """URLs whose hash key is in the cache."""
    return _with_key(urls, url, key).join(cache.select(key), key, "left_semi").select(urls.columns)


def cache_misses(urls: DataFrame, cache: DataFrame, url: str = "url", key: str = "cache_key") -> DataFrame:
    """URLs still to be fetched."""
    return _with_key(urls, url, key).join(cache.select(key), key, "left_anti").select(urls.columns)


def _with_key(urls: DataFrame, url: str, key: str) -> DataFrame:
    return urls.withColumn(key, cache_key(F.col(url)))


def filename_collisions(pages: DataFrame, name: Column) -> DataFrame:
    """``(filename, n_pages)`` of file names that more than one page maps to."""
    return (
        pages.select(name.alias("filename"))
        .groupBy("filename")
        .agg(F.count("*").alias("n_pages"))
        .filter("n_pages > 1")
    )


def last_write(pages: DataFrame, name: Column, order: str) -> DataFrame:
    """The page that a file name ends up with: the last one written.

    An aggregate, not a ranking window: it combines map-side, so a name shared by a
    third of all pages is no hot partition.  Only order values are shuffled.
    """
    return pages.groupBy(name.alias("filename")).agg(
        F.max(order).alias(order), F.count("*").alias("n_writes")
    )
