"""Markdown rendering of HTML tokens.

The tokens of a page, in order, go through one pass (``markdown_pages``) that writes its Markdown. What needs the
text of a tag or character references is made by column functions before. The pass needs no shuffle: the tokens
lie partitioned by page as ``content_tokens`` left them, and are already sorted.

Own rules where the output format leaves a choice: ``\\``, ``*``, ``[``, ``]``, a
backtick and an underscore at a word edge are escaped in text, and ``#``, ``>``,
``-``, ``+``, ``1.`` where they would open a block.  An inline element left open
ends with its block.  Two or more line breaks in a row end the paragraph.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from webquire.functions.text import md_path, tidy_newlines
from webquire.functions.urls import let
from webquire.operators.html import WS, attribute, content_tokens, token_text
from webquire.operators.markdown_pages import L_CLOSE, L_END, pages_text

# --- fixed values -------------------------------------------------------------
# percent escapes in link targets
TARGET_ESCAPES = {" ": "%20", "[": "%5B", "]": "%5D", "(": "%28", ")": "%29", "<": "%3C", ">": "%3E"}
# ------------------------------------------------------------------------------


def _link_tail(token: Column) -> Column:
    """What closes a link: stand-in, target and title."""
    target = attribute(token, "href")
    for char, escape in TARGET_ESCAPES.items():
        target = F.replace(target, F.lit(char), F.lit(escape))
    title = attribute(token, "title")
    titled = F.when(
        F.lower(token).contains("title") & (title != ""),
        F.concat(F.lit(' "'), F.regexp_replace(title, '"', '\\\\"'), F.lit('"')),
    ).otherwise("")
    return F.concat(F.lit(L_CLOSE + "("), target, titled, F.lit(L_END))


def to_markdown(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """``(key, page, markdown)`` from ``content_tokens``; one row per page."""
    tag, start, token = F.col("tag"), F.col("kind") == "start", F.col("token")
    link = F.when(start & (tag == "a") & F.lower(token).contains("href"), _link_tail(token))
    link = let(link, lambda tail: F.when(~tail.contains(L_CLOSE + "(" + L_END), tail))
    first_number = F.expr(
        "coalesce(try_cast(nullif(regexp_extract(token, '(?i)[ \\t\\n\\f\\r]start[ \\t\\n\\f\\r]*=[ \\t\\n\\f\\r]*[\"\\']?([0-9]++)', 1), '') as int), 1)"
    )
    lang = rf"(?i)class[{WS}]*=[{WS}]*[^>]*?\b(?:language|lang)-([A-Za-z0-9_+#.\-]+)"
    rows = tokens.select(
        key, "pos", "kind", "tag", "open_pos", "close_pos", F.col("region.close_pos").alias("region_end"),
        token_text(F.col("kind"), token).alias("text"),
        link.alias("link"),
        F.when(start & tag.isin("ul", "ol"), first_number).alias("number"),
        F.when(start & F.lower(token).contains("lang"), F.regexp_extract(token, lang, 1)).alias("lang"),
        "page",
    )
    schema = StructType([StructField(key, tokens.schema[key].dataType), StructField("page", tokens.schema["page"].dataType), StructField("markdown", StringType())])
    done = rows.sortWithinPartitions(key, "pos").mapInArrow(partial(pages_text, schema=to_arrow_schema(schema)), schema)
    return done.withColumn("markdown", tidy_newlines("markdown"))


def convert(
    pages: DataFrame,
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
    key: str = "page_id",
    html: str = "html",
    path: str | None = None,
    keep: Sequence[str] = (),
    size: int | None = None,
) -> DataFrame:
    """``(key, *keep, path, markdown, status, error)``: one row per page.

    ``path`` names the column whose extension becomes ``.md`` (a key called ``path`` is
    handed on as ``source``).  A page without HTML is an ``error`` row; the others go on.
    ``size``: the bytes of HTML, if known.
    """
    carried = list(dict.fromkeys([*keep, *([path] if path and path != key else [])]))
    tokens = content_tokens(pages, key, html, strip_tags, strip_classes, keep=carried, size=size)
    done = to_markdown(tokens, key)
    missing = F.col("page.missing")
    source = F.col(key) if path == key else F.col(f"page.{path}") if path else F.col(key).cast("string")
    return done.select(
        F.col(key).alias("source" if key == "path" else key),
        *[F.col(f"page.{k}").alias(k) for k in keep],
        md_path(source).alias("path"),
        F.when(~missing, F.col("markdown")).alias("markdown"),
        F.when(missing, "error").otherwise("ok").alias("status"),
        F.when(missing, "page has no html").alias("error"),
    )
