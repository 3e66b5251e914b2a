"""HTML as tables: tokens, elements with intervals, main region, stripping, text.

A page is cut into tokens by one lossless regular expression, so no parser runs
outside of Catalyst.  Nesting comes from windows over the tokens.  All windows
partition by the page key (plus the tag at most); ``by_page`` hash-partitions the
compact page rows once *before* the explode, and every window and grouping after
it reuses that partitioning without another shuffle.  The windows sort a partition's
tokens several times over, so partitions hold a bounded number of bytes of HTML.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquire.functions.markup import END_OF_PAGE, WS, attribute, attributes
from webquire.functions.text import split_names, unescape_html
from webquire.operators.selectors import with_selected

# --- fixed values -------------------------------------------------------------
# elements whose inside is never markup
RAW_TEXT = ("script", "style", "noscript", "iframe", "noembed", "noframes", "xmp", "title", "textarea")
# elements without an end tag
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# always removed from the content
MEDIA = ("img", "svg", "picture")
# removed when Markdown is rendered
NON_CONTENT = ("head", "script", "style", "link", "meta", "iframe", "noscript", "input", "textarea")
# raw elements whose inside is still readable text
RAW_SHOWN = ("xmp",)
# elements in which the ones with optional end tags stand
SCOPES = ("ul", "ol", "menu", "dl", "table", "select")
# optional end tags: the element, the start tags that end it within its scope
OPTIONAL_END = (
    (("li",), ("li",)),
    (("dt", "dd"), ("dt", "dd")),
    (("option",), ("option", "optgroup")),
    (("td", "th"), ("td", "th", "tr", "thead", "tbody", "tfoot")),
    (("tr",), ("tr", "thead", "tbody", "tfoot")),
    (("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot")),
)
# start tags that end a paragraph
ENDS_P = (
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul",
    "li", "dt", "dd", "td", "th", "tr",
)
# elements whose end also ends a paragraph inside
HOLDS_P = tuple(t for t in ENDS_P if t not in ("p", "hr")) + ("body", "html")
# bytes of HTML in one partition of pages; a task needs up to about 100 times as much for its sorts
PARTITION_BYTES = 4 << 20
# ------------------------------------------------------------------------------

# after a tag name: a quote delimits a value only directly behind "="; a tag may meet the end of the page
TAG_REST = rf"(?:[^>=]++|=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+(?:>|\z)"
TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<({'|'.join(RAW_TEXT)})(?=[{WS}/>]){TAG_REST}.*?(?:</\1(?=[{WS}/>])[^>]*+>|\z)"
    rf"|</?[a-z]{TAG_REST}"
    r"|<[!?/][^>]*+(?:>|\z)"
    r"|[^<]++|<"
)
# an entry of a strip list that is a plain name
BARE = re.compile(r"[^\s>.#\[\]:*+~(),=\"']+")
TAG_NAME = rf"^</?([A-Za-z][^{WS}/>]*)"


def by_page(pages: DataFrame, key: str, html: str = "html", keep: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """The one shuffle of the HTML chain: page rows by key, before they are exploded.

    There are as many partitions as ``size``, the bytes of HTML, asks for; it is counted if not given.  Adaptive
    execution would merge them by the compact rows' size, which tells little of what a task holds after the explode.
    """
    rows, spark = pages.select(key, *keep, html), pages.sparkSession
    if pages.isStreaming:
        return rows.repartition(key)
    if size is None:
        size = html_bytes(pages, html)
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(max(least, -(-size // PARTITION_BYTES)), key)


def html_bytes(pages: DataFrame, html: str = "html") -> int:
    return pages.agg(F.sum(F.octet_length(html))).head()[0] or 0


def token_array(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _kind(token: Column, tag: Column) -> Column:
    return (
        F.when(~token.startswith("<") | (token == "<"), "text")
        .when(tag == "", "comment")
        .when(~token.endswith(">") & (~tag.isin(*RAW_TEXT) | token.startswith("</")), "comment")
        .when(token.startswith("</"), "end")
        .when(tag.isin(*RAW_TEXT), "raw")
        .when(tag.isin(*VOID), "void")
        .otherwise("start")
    )


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, pos, kind, tag, token)``: every token of every page; concatenated they are the page.

    ``kind`` is text, comment, raw (a whole raw-text element), void, start or end.  A tag
    that the end of the page cuts off counts as a comment, as HTML parsers drop it.
    """
    # the outer form, because the inner one makes the optimizer run the expression three times
    tokens = pages.select(key, F.posexplode_outer(token_array(F.col(html))).alias("pos", "token")).filter(
        F.col("pos").isNotNull()
    )
    tag = F.lower(F.regexp_extract("token", TAG_NAME, 1))
    return tokens.withColumn("tag", tag).select(
        key, "pos", _kind(F.col("token"), F.col("tag")).alias("kind"), "tag", "token"
    )


def html_attrs(tokens: DataFrame) -> DataFrame:
    """Attribute map of every tag that can have one."""
    return tokens.filter(F.col("kind").isin("start", "void", "raw")).withColumn(
        "attrs",
        attributes(F.regexp_extract("token", rf"(?is)^(<[a-z]{TAG_REST})", 1)),
    )


def _implied_end(tokens: DataFrame, key: str) -> DataFrame:
    """Add ``implied``: the token before which a start tag with an optional end tag ends at the latest.

    ``scope`` is the depth in lists and tables; a scope's own tags belong to the outside
    when they open it and to the inside when they close it, so within one depth the next
    tag that ends the element is the one wanted.  The next one is the smallest of a
    running minimum over the tokens in descending order: a frame that only grows, where
    one that runs ahead would be read again for every token.
    """
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    tag, pos = F.col("tag"), F.col("pos")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key, "scope").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(start & tag.isin(*SCOPES), 1).when(end & tag.isin(*SCOPES), -1)
    leaves = end & tag.isin(*SCOPES)
    implied = [
        F.when(start & tag.isin(*own), F.min(F.when(leaves | (start & tag.isin(*enders)), pos)).over(ahead)) for own, enders in OPTIONAL_END
    ]
    ends_p = ((start | (F.col("kind") == "void")) & tag.isin(*ENDS_P)) | (end & tag.isin(*HOLDS_P))
    implied.append(F.when(start & (tag == "p"), F.min(F.when(ends_p, pos)).over(ahead)))
    return tokens.withColumn("scope", F.coalesce(F.sum(step).over(so_far), F.lit(0))).withColumn("implied", F.coalesce(*implied)).drop("scope")


def _paired(tokens: DataFrame, key: str) -> DataFrame:
    """Add ``close_pos`` to start tags and ``open_pos`` to end tags.

    The depth of a tag within its own name gives each pair a common level; two
    starts on one level always have an end between them, so the neighbour in
    (page, tag, level) is the mate.  An element whose end tag may be left out ends
    before the tag that implies its end, if that comes first; an end tag that is then
    without a start has no ``open_pos``.  Other unclosed starts keep NULL.
    """
    by_tag = Window.partitionBy(key, "tag").orderBy("pos")
    by_level = Window.partitionBy(key, "tag", "level").orderBy("pos")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    early = F.col("implied") < F.col("next_pos")
    return (
        _implied_end(tokens, key)
        .withColumn("depth", F.sum(step).over(by_tag))
        .withColumn("level", F.when(F.col("kind") == "end", F.col("depth") + 1).otherwise(F.col("depth")))
        .withColumn("next_pos", F.lead("pos").over(by_level))
        .withColumn("prev", F.lag(F.struct("kind", "pos", "implied")).over(by_level))
        .withColumn(
            "close_pos",
            F.when(F.col("kind") == "start", F.when(early | F.col("next_pos").isNull(), F.col("implied") - 1).otherwise(F.col("next_pos"))),
        )
        .withColumn(
            "open_pos",
            F.when(
                (F.col("kind") == "end") & (F.col("prev.kind") == "start") & ~F.coalesce(F.col("prev.implied") < F.col("pos"), F.lit(False)),
                F.col("prev.pos"),
            ),
        )
        .drop("depth", "next_pos", "prev", "implied", "level")
    )


def html_elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, tag, open_pos, close_pos, token)``: one row per element, interval-encoded.

    Void and raw-text elements are one-token intervals; an element without end tag
    has a NULL ``close_pos``.
    """
    tags = html_tokens(by_page(pages, key, html), key, html).filter(
        F.col("kind").isin("start", "end", "void", "raw")
    )
    # one-token elements add nothing to the depths; they only pass through the pairing
    single = F.col("kind").isin("void", "raw")
    return _paired(tags, key).filter(F.col("kind") != "end").select(
        key, "tag", F.col("pos").alias("open_pos"), F.when(single, F.col("pos")).otherwise(F.col("close_pos")).alias("close_pos"), "token"
    )


def _page_tokens(pages: DataFrame, key: str, html: str, keep: Sequence[str], size: int | None = None) -> DataFrame:
    """Content tokens of each page plus one ``eof`` row, on which the ``keep`` columns ride.

    The ``eof`` row stands for the page itself, so that a page without any content
    (or without HTML) needs no join to stay in the result.
    """
    with_end = F.concat(F.coalesce(token_array(F.col(html)), F.array().cast("array<string>")), F.array(F.lit("")))
    exploded = by_page(pages, key, html, keep, size).select(
        key, *keep, F.col(html).isNull().alias("missing"), F.posexplode_outer(with_end).alias("pos", "token")
    )
    at_end = F.col("token") == ""
    tag = F.lower(F.regexp_extract("token", TAG_NAME, 1))
    tokens = exploded.select(
        key,
        "pos",
        F.when(at_end, "eof").otherwise(_kind(F.col("token"), tag)).alias("kind"),
        tag.alias("tag"),
        "token",
        F.when(at_end, F.struct("missing", *keep)).alias("page"),
    )
    dropped = (F.col("kind") == "comment") | ((F.col("kind") == "raw") & ~F.col("tag").isin(*RAW_SHOWN))
    return tokens.filter(~dropped)


def _add_region(tokens: DataFrame, key: str) -> DataFrame:
    """Add ``region`` (tier, open_pos, close_pos) of the page's main content to each token."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    page = Window.partitionBy(key)
    tag, kind = F.col("tag"), F.col("kind")
    opens = kind.isin("start", "void")
    end = F.when(kind == "void", F.col("pos")).otherwise(F.coalesce("close_pos", F.lit(END_OF_PAGE)))
    # role is read only where a tag mentions it
    role = F.when(opens & F.lower("token").contains("role"), attribute(F.col("token"), "role", decode=False))
    in_main = F.max(F.when(opens & (tag == "main"), end)).over(so_far) >= F.col("pos")
    tier = (
        F.when(opens & (tag == "article") & in_main, 1)
        .when(opens & (tag == "main"), 2)
        .when(role == "main", 3)
        .when(opens & (tag == "article"), 4)
        .when(opens & (tag == "body"), 5)
    )
    candidate = F.when(
        F.col("tier").isNotNull(),
        F.struct("tier", F.col("pos").alias("open_pos"), end.cast("int").alias("close_pos")),
    )
    whole = F.struct(F.lit(6).alias("tier"), F.lit(-1).alias("open_pos"), F.lit(END_OF_PAGE).alias("close_pos"))
    return (
        tokens.withColumn("tier", tier)
        .withColumn("region", F.coalesce(F.min(candidate).over(page), whole))
        .drop("tier")
    )


def _keep_region(tokens: DataFrame) -> DataFrame:
    inside = F.col("pos").between(F.col("region.open_pos"), F.col("region.close_pos"))
    return tokens.filter(inside | (F.col("kind") == "eof"))


def _strip(tokens: DataFrame, key: str, tags: Sequence[str], classes: Sequence[str]) -> DataFrame:
    """Drop the named and the ``selected`` elements with everything inside them, below the region root."""
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.col("kind").isin("start", "void", "raw")
    hit = F.col("tag").isin(*[t.lower() for t in tags]) if tags else F.lit(False)
    if classes:
        names = F.split(
            F.when(F.lower("token").contains("class"), attribute(F.col("token"), "class", decode=False)).otherwise(""), rf"[{WS}]+"
        )
        hit = hit | F.arrays_overlap(names, F.array(*[F.lit(c) for c in classes]))
    if "selected" in tokens.columns:
        hit = hit | F.col("selected")
    until = (
        F.when(F.col("kind") != "start", F.col("pos"))
        .when((F.col("tag") == "head") & F.col("close_pos").isNull(), F.col("pos"))
        .otherwise(F.coalesce("close_pos", "region.close_pos"))
    )
    below = F.col("pos") > F.col("region.open_pos")
    return (
        tokens.withColumn("cut_to", F.max(F.when(opens & below & hit, until)).over(so_far))
        .filter((F.col("kind") == "eof") | F.col("cut_to").isNull() | (F.col("cut_to") < F.col("pos")))
        .drop("cut_to", "selected")
    )


def main_content(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``(key, tier, open_pos, close_pos)``: the main-content interval of each page.

    First match in document order of the first selector that matches at all; tier 6
    is the whole document.  An unclosed element ends with the page (NULL here).
    """
    found = _add_region(_paired(_page_tokens(pages, key, html, ()), key), key)
    bounded = F.when(F.col("region.close_pos") < END_OF_PAGE, F.col("region.close_pos"))
    return found.filter(F.col("kind") == "eof").select(
        key, "region.tier", F.col("region.open_pos").alias("open_pos"), bounded.alias("close_pos")
    )


def content_tokens(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
    keep: Sequence[str] = (),
    region: bool = True,
    media: bool = True,
    non_content: bool = True,
    size: int | None = None,
) -> DataFrame:
    """Tokens of the main content after stripping, with pairing columns, and the ``eof`` row.

    An entry of ``strip_tags`` is a tag name or a selector (``operators.selectors``), one of ``strip_classes`` a class
    name or what follows the dot of one.  ``size``: the bytes of HTML, if known (``by_page``).
    """
    names, marked = split_names(strip_tags), split_names(strip_classes)
    selectors = [s for s in names if not BARE.fullmatch(s)] + [f".{c}" for c in marked if not BARE.fullmatch(c)]
    tokens = _paired(_page_tokens(pages, key, html, keep, size), key)
    if selectors:
        # before the region is cut out, as an element around it counts
        tokens = with_selected(tokens, key, selectors)
    tokens = _keep_region(_add_region(tokens, key)) if region else tokens.withColumn(
        "region",
        F.struct(F.lit(6).alias("tier"), F.lit(-1).alias("open_pos"), F.lit(END_OF_PAGE).alias("close_pos")),
    )
    tags = [t for t in names if BARE.fullmatch(t)] + list(MEDIA if media else ()) + list(NON_CONTENT if non_content else ())
    classes = [c for c in marked if BARE.fullmatch(c)]
    return _strip(tokens, key, tags, classes) if tags or classes or selectors else tokens


def raw_inner(token: Column) -> Column:
    """What stands between the tags of a raw-text element."""
    return F.regexp_replace(token, rf"(?is)^<[a-z]{TAG_REST}|</[a-z][^>]*+>$", "")


def token_text(kind: Column, token: Column) -> Column:
    """Readable text of a token: decoded, empty for tags."""
    return F.when(kind == "text", unescape_html(token)).when(kind == "raw", raw_inner(token)).otherwise("")


def html_text(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    strip_tags: Sequence[str] | str | None = None,
    strip_classes: Sequence[str] | str | None = None,
) -> DataFrame:
    """``(key, text)``: the readable text of the main content, in document order."""
    # the text is a column of its own, so that it is compiled, not interpreted in the aggregate
    tokens = content_tokens(pages, key, html, strip_tags, strip_classes).select(
        key, F.struct("pos", token_text(F.col("kind"), F.col("token")).alias("text")).alias("part")
    )
    return tokens.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), "").alias("text")
    )
