"""Crawl, convert and combine in sequence, with a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquire.functions.text import md_path
from webquire.functions.urls import normalize_url, url_to_filename
from webquire.operators.markdown import convert
from webquire.operators.packing import DEFAULT_MAX_WORDS
from webquire.operators.report import build_report, outcome_union, retry_items
from webquire.plans.combine import combine
from webquire.plans.crawl import crawl
from webquire.session import cut
from webquire.sources.readers import read_report
from webquire.sources.writers import write_report


@dataclass
class Corpus:
    parts: DataFrame
    summary: DataFrame
    outcomes: DataFrame
    report: DataFrame
    chunks: DataFrame  # the text of the parts in rows of bounded size


def build_corpus(
    pages: DataFrame,
    seed: str,
    max_pages: int = 0,
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
    max_words: int | None = DEFAULT_MAX_WORDS,
    output: str = "combined.md",
    url: str = "url",
    html: str = "html",
    final_url: str | None = None,
    error: str | None = None,
    report_path: str | None = None,
) -> Corpus:
    """The parts of the site below ``seed``, one outcome row per item of each step, and the report of both steps.

    ``final_url`` and ``error`` name the store's columns for redirects and fetch errors.  The report is
    written to ``report_path`` if that is given; ``retry_report`` crawls its failed items again.
    """
    began = _now(pages)
    walked = cut(crawl(pages, seed, max_pages, url=url, html=html, final_url=final_url, error=error), "walked")
    crawled = _now(pages)
    saved = walked.filter(F.col("status") == "ok").select("url", "crawl_order")
    # several URLs can share a file name: the page written last is the one converted
    winner = (
        saved.groupBy(url_to_filename("url").alias("filename"))
        .agg(F.max_by("url", "crawl_order").alias("url"))
    )
    stored = pages.select(normalize_url(url).alias("url"), F.col(html).alias("html")).filter(F.col("html").isNotNull())
    # the store should hold one row per URL; of several, the one with the smallest hash is taken
    least = stored.select("url", F.struct(F.xxhash64("html").alias("h"), F.octet_length("html").alias("size")).alias("page")).groupBy("url").agg(F.min("page").alias("page"))
    one = cut(least.join(winner, "url").select("url", "page.h", "page.size", "filename"), "chosen")
    size = one.agg(F.sum("size")).head()[0] or 0
    files = stored.withColumn("h", F.xxhash64("html")).join(one.drop("size"), ["url", "h"]).dropDuplicates(["url", "h"]).select("filename", "html")
    docs = cut(convert(files, strip_tags, strip_classes, key="filename", html="html", path="filename", size=size), "converted")
    converted = _now(pages)
    done = combine(docs.filter(F.col("status") == "ok").withColumnRenamed("markdown", "content"), max_words, output=output)
    outcomes = outcome_union(
        walked.select(F.lit("crawl").alias("step"), "url", url_to_filename("url").alias("path"), "status", "error"),
        docs.select(F.lit("convert").alias("step"), F.col("filename").alias("url"), md_path("filename").alias("path"), "status", "error"),
    )
    # the store holds no time per item, so an item has the time at which its step ended
    timed = outcomes.withColumn("time", F.when(F.col("step") == "crawl", F.lit(crawled)).otherwise(F.lit(converted)))
    report = build_report(timed, F.lit(began))
    if report_path:
        write_report(report, report_path)
        report = read_report(pages.sparkSession, report_path)
    return Corpus(done.parts, done.summary, outcomes, report, done.chunks)


def retry_convert(
    files: DataFrame,
    reports: DataFrame,
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
    path: str = "path",
    html: str = "content",
) -> DataFrame:
    """Convert again the files that the convert step of ``reports`` lists as failed; ``convert``'s columns.

    The items of that step are file names, compared as they are.  ``files`` may come from ``read_html``; the rows of a
    page store are named by ``url_to_filename``.
    """
    return convert(retry_items(files, reports, "convert", path), strip_tags, strip_classes, key=path, html=html, path=path)


def _now(pages: DataFrame) -> datetime:
    return pages.sparkSession.range(1).select(F.current_timestamp()).first()[0]
