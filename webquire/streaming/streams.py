"""Structured Streaming forms of convert, link discovery and the crawl."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webquire.functions.urls import in_scope, is_http
from webquire.operators.links import extract_links, link_table, normal_seed, scope_filter
from webquire.operators.markdown import convert

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_html(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New ``.html`` files of a directory as ``(path, content)``."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.[hH][tT][mM][lL]")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select("path", F.col("content").cast("string").alias("content"))


def stream_convert(
    pages: DataFrame,
    out: str,
    checkpoint: str,
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
    key: str = "path",
    html: str = "content",
    path: str | None = "path",
    keep: Sequence[str] = (),
) -> StreamingQuery:
    """Convert each micro-batch and write it under its batch number.

    A batch that is run again after a failure replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        convert(batch, strip_tags, strip_classes, key, html, path, keep).write.mode("overwrite").parquet(
            f"{out}/batch={number}"
        )

    return (
        pages.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_links(
    pages: DataFrame, seed: str | None = None, url: str = "url", html: str = "html", event_time: str | None = None, delay: str = "1 day"
) -> DataFrame:
    """First-seen link targets of a stream of pages, in the seed's scope if one is given.

    Extraction and filtering are row-local; the only state is the set of distinct
    targets, hash-partitioned by target (keep it in RocksDB for large crawls).  It grows
    with the targets.  With ``event_time`` it is bounded: a target is known for at least
    ``delay`` after it was seen, and its time is handed on.
    """
    links = extract_links(pages, url, html, keep=[event_time] if event_time else [])
    if seed:
        links = scope_filter(links, seed)
    if event_time:
        return links.select("dst_url", event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["dst_url"])
    return links.select("dst_url").dropDuplicates(["dst_url"])


# What reaches a URL: ``links`` of its page (``ok``: it has HTML), or without them the news that a page ``depth`` - 1 points to it.
MESSAGE = ("links", "ok", "stored_error", "depth")
# What a URL tells: a target that it points to, or with ``fetched`` how it stands itself.
NEWS = "url string, depth int, fetched boolean, ok boolean, stored_error string"
NEWS_COLUMNS = pd.Index([c.split()[0] for c in NEWS.split(", ")], dtype=object)
# depth: null until some reached page points here; the rest is null until the page has come.
KNOWN = "depth int, links array<string>, ok boolean, stored_error string"


def _meet(key: tuple[str], messages: Iterator[pd.DataFrame | dict[str, list]], state: GroupState, keep_ms: int | None) -> Iterator[pd.DataFrame]:
    """One URL takes its messages: it tells its links once it is both reached and fetched, and again when reached sooner."""
    if state.hasTimedOut:
        state.remove()  # a page that nothing pointed to for so long
        return
    depth, links, ok, error = state.get if state.exists else (None, None, None, None)
    before, had = depth, links is not None
    for batch in messages:
        for its_links, its_ok, its_error, its_depth in zip(*(batch[c] for c in MESSAGE)):
            if its_links is None:
                depth = int(its_depth) if depth is None else min(depth, int(its_depth))
            else:
                links = list(dict.fromkeys([*(links if links is not None else []), *its_links]))
                ok, error = bool(ok or its_ok), min((e for e in (error, its_error) if e is not None), default=None)
    state.update((depth, links, ok, error))
    if depth is None:
        if keep_ms is not None:
            state.setTimeoutDuration(keep_ms)
        return
    if depth != before or (links is not None) != had:
        rows = [(key[0], depth, links is not None, ok, error), *((link, depth + 1, None, None, None) for link in links or [])]
        # one block of objects: a frame is made for every URL, and types that pandas infers or casts cost more than the rest
        yield pd.DataFrame(np.array(rows, dtype=object), columns=NEWS_COLUMNS, dtype=object)


def _meet_packed(key: tuple[str], messages: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None) -> Iterator[pd.DataFrame]:
    """``_meet`` of messages in one column of structs: Spark converts every column of every URL by itself, which takes longer than all else."""
    yield from _meet(key, ({c: [m[c] for m in batch["message"]] for c in MESSAGE} for batch in messages), state, keep_ms)


def stream_discovery(
    pages: DataFrame,
    seed: str,
    out: str,
    checkpoint: str,
    url: str = "url",
    html: str = "html",
    final_url: str | None = None,
    error: str | None = None,
    keep: int | None = None,
) -> StreamingQuery:
    """Crawl a stream of pages that come in any order: the running query, whose findings ``discovered`` reads from ``out``.

    Each URL has a state of its own, hash-partitioned by URL: whether and how soon it is reached from ``seed``, and what
    its page holds once that has come.  What a reached page points to is written to ``out`` and read back as the next
    input, so levels follow one another within the query; a URL that is reached on a shorter way tells its links again.
    A batch that runs again replaces its own output.  ``keep``: milliseconds after which a page is forgotten that
    nothing has pointed to (such a query runs batches for its timers and never rests); without it the state grows with
    the pages.
    """
    spark = pages.sparkSession
    base = normal_seed(spark, seed)
    if base is None:
        raise ValueError(f"invalid seed: {seed}")
    _tell(spark.createDataFrame([(base, 0, None, None, None)], NEWS), out, -1)
    inside = F.filter("links", lambda link: in_scope(F.lit(base), link) & is_http(link))
    come = link_table(pages, url, html, final_url, error).select(
        "url", F.coalesce(inside, F.array().cast("array<string>")).alias("links"), F.col("has_html").alias("ok"), "stored_error", F.lit(None).cast("int").alias("depth")
    )
    told = spark.readStream.schema(f"{NEWS}, batch int").parquet(f"{out}/told=true")
    told = told.select("url", F.lit(None).cast("array<string>").alias("links"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("stored_error"), "depth")
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.ProcessingTimeTimeout
    messages = come.unionByName(told).select("url", F.struct(*MESSAGE).alias("message"))
    news = messages.groupBy("url").applyInPandasWithState(partial(_meet_packed, keep_ms=keep), NEWS, KNOWN, "update", timeout)

    def write(batch: DataFrame, number: int) -> None:
        # a target that many pages name is told once in a batch
        _tell(batch.groupBy("url", "fetched", "ok", "stored_error").agg(F.min("depth").alias("depth")), out, number)

    return news.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).start()


def _tell(news: DataFrame, out: str, number: int) -> None:
    """Write the news of one batch in place of what it may have told before; targets stand apart, as they are read again.

    A batch without targets makes no file that is, so the stream comes to rest.
    """
    rows = news.withColumn("told", F.col("fetched").isNull()).withColumn("batch", F.lit(number))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("told", "batch").parquet(out)


def discovered(spark: SparkSession, out: str) -> DataFrame:
    """``(url, depth, status, error)`` of the URLs that ``stream_discovery`` has reached so far."""
    news = spark.read.schema(f"{NEWS}, told boolean, batch int").parquet(out)
    ok = F.coalesce(F.max("ok"), F.lit(False))
    reason = F.when(F.max("fetched"), F.coalesce(F.min("stored_error"), F.lit("page has no html"))).otherwise("not in page store")
    return news.groupBy("url").agg(F.min("depth").alias("depth"), F.when(ok, "ok").otherwise("error").alias("status"), F.when(~ok, reason).alias("error"))
