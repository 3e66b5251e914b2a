"""The registered queries: each operator over the given tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webquire.functions import text as T
from webquire.functions import urls as U
from webquire.operators import html as H
from webquire.operators import links as L
from webquire.operators import markdown as M
from webquire.operators import packing as P
from webquire.operators import report as R
from webquire.plans.build import build_corpus, retry_convert
from webquire.plans.combine import combine
from webquire.plans.crawl import crawl, crawl_retry, retry_report, seeds
from webquire.session import qualified, work_path
from webquire.sources.readers import read_html, read_markdown, read_pages, read_report, read_zip
from webquire.sources.writers import write_docs, write_files, write_parts, write_report
from webquire.streaming.streams import discovered, stream_convert, stream_discovery, stream_links

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = "https://site.test/docs"
RUN_TIME = "2026-01-01 00:00:00"
# Variants of every page URL, and references resolved against every page URL.
URL_VARIANTS = ("{u}", "{u}/", "  {u}\t", "{u}/a b/(c)/", "{u}/%2Fx%41ü/", "{u}/%zz", "{u}?q=ü y/", "{u}#a%zz")
HREFS = (
    "/p", "p", "./p/", "../p", "../../../p", "a/./b/../c", "?z=2", "?", "", "#f", "//Host.test/x/../y/", "//", "///x",
    "HTTP://Other.test", "mailto:a@b", "javascript:void(0)", "für/ä b", "%zz", "1:2", "./1:2", "/a(b)?x y", "a%2fb/", ".", "..",
)
# Rewrites that give every page another shape of main content.
SHAPES = (
    (),
    (("<article>", "<main><section><article>"), ("</article>", "</article></section></main>")),
    (("<article>", "<div role=\"main\">"), ("</article>", "</div>")),
    (("<article>", "<section>"), ("</article>", "</section>")),
    (("<article>", "<main>"), ("</article>", "</main>")),
    (("</article>", "<p class=\"x ad\">gone<p>stays<ul><li class=\"ad\">x<li>y<ul><li>z</ul></ul><table><tr><td class=\"ad\">a<td>b<tr><td>c</table></article>"),),
    (("</body></html>", "<p>hello <a href=\"x\" class=\"y"),),
    (("<h1>", "<h1><img src=x><svg><g>s</g></svg><picture><img></picture>"), ("<p>", "<nav>n</nav><div class=\"x ad\">a<div>d</div></div><p>")),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages")


def url_variants(spark: SparkSession, sf: str) -> DataFrame:
    """``(page_id, v, u)``: every page URL in several spellings."""
    upper = F.concat(F.upper(F.substring_index("url", "/", 3)), F.lit("/Dir/"))
    forms = [F.replace(F.lit(v), F.lit("{u}"), F.col("url")) for v in URL_VARIANTS]
    forms += [upper, F.regexp_replace("url", "^[a-z]+:", ""), F.substring_index("url", "/", 3), F.lit("")]
    return pages(spark, sf).select("page_id", F.posexplode(F.array(*forms)).alias("v", "u"))


def shaped_pages(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    """``(key, html)``: every page in every shape.

    For a shuffle by ``key`` the pages are ``dealt`` by their bytes while they are one row each: the shuffle holds what
    a task gives to it, and that would be all shapes of a file.
    """
    source, forms = pages(spark, sf), []
    for edits in SHAPES:
        form = F.col("html")
        for old, new in edits:
            form = F.replace(form, F.lit(old), F.lit(new))
        forms.append(form)
    source = H.by_page(source, "page_id") if dealt else source
    exploded = source.select("page_id", F.posexplode(F.array(*forms)).alias("shape", "html"))
    return exploded.select((F.col("page_id") * 10 + F.col("shape")).alias("key"), "html")


def site(spark: SparkSession, sf: str) -> DataFrame:
    """A linked site made of the pages: page ``i`` points to ``2i+1`` and ``2i+2`` modulo
    the number of pages, to a missing page, out of scope and to a mail address."""
    source = pages(spark, sf)
    n = source.count()
    name = F.when(F.col("page_id") == 0, "").otherwise(F.concat(F.lit("/"), F.col("page_id").cast("string")))
    nav = F.format_string(
        '<a href="/docs/%d">a</a><a href="/docs/x/../%d/#t">b</a><a href="/docs">h</a>'
        '<a href="/docs/missing-%d">m</a><a href="/other">o</a><a href="mailto:x@y.z">e</a>',
        (F.col("page_id") * 2 + 1) % n, (F.col("page_id") * 2 + 2) % n, F.col("page_id") % 7,
    )
    return source.select(F.concat(F.lit(SEED), name).alias("url"), F.concat(nav, F.col("html")).alias("html"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"),
        F.col("text").alias("content"),
        "source",
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Status rows derived from the pages: pages without a closing ``html`` tag fail."""
    failed = ~F.col("html").contains("</html>")
    base = pages(spark, sf).select(
        F.col("url"),
        F.explode(F.array(F.lit("crawl"), F.lit("convert"))).alias("step"),
        failed.alias("bad"),
    )
    return base.groupBy("step", "url").agg(F.max("bad").alias("bad")).select(
        "step",
        "url",
        F.when(F.col("bad"), "error").otherwise("ok").alias("status"),
        F.when(F.col("bad"), F.concat(F.lit("cut off: "), F.col("step"))).alias("error"),
        F.to_timestamp(F.lit(RUN_TIME)).alias("time"),
    )


def reports(spark: SparkSession, sf: str) -> DataFrame:
    return R.build_report(outcomes(spark, sf), F.to_timestamp(F.lit(RUN_TIME)))


def by_host(spark: SparkSession, sf: str) -> DataFrame:
    """Converted text of each page as a document of its host's corpus."""
    text = H.html_text(pages(spark, sf), strip_tags="nav,footer", strip_classes="ad")
    named = pages(spark, sf).select(
        "page_id", U.host_of("url").alias("host"),
        F.concat(U.host_of("url"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"),
    )
    return text.join(named, "page_id").select("path", F.col("text").alias("content"), "host")


# --- sources and sinks --------------------------------------------------------


@query
def scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet").select("url", "html")


@query
def files_html(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "html")
    write_files(last_pages(spark, sf).select("path", "content"), out)
    return read_html(spark, out)


def last_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Last page of each file name, as ``(path, content)``."""
    source = pages(spark, sf).withColumn("path", U.url_to_filename("url"))
    last = L.last_write(source, F.col("path"), "page_id")
    return source.join(last.select("page_id"), "page_id", "left_semi").select("path", F.col("html").alias("content"))


def _unreadable(rows, place: str) -> None:
    """A file per row that opens and cannot be read, in a folder on this machine."""
    import os
    from urllib.parse import unquote, urlparse

    root = unquote(urlparse(place).path)
    for row in rows:
        os.makedirs(f"{root}/damaged", exist_ok=True)
        os.symlink("/proc/self/mem", f"{root}/damaged/{row['doc_id']}.md")


@query
def corpus_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus of a folder to which files are added that cannot be read: they count, and hold no words."""
    out = work_path(spark, "md")
    write_files(documents(spark, sf), out)
    more = table(spark, sf, "documents").filter("doc_id % 10 = 0").select("doc_id")
    more.foreachPartition(lambda rows, place=qualified(spark, out): _unreadable(rows, place))
    return combine(read_markdown(spark, out), 3_000).summary


@query
def files_markdown(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "md")
    write_files(documents(spark, sf), out)
    return read_markdown(spark, out)


# pages in one archive, so that archives stay small however many pages there are
ZIP_PAGES = 200


@query
def files_zip(spark: SparkSession, sf: str) -> DataFrame:
    """All pages, zipped by the executors, then read back."""
    out = work_path(spark, "zip")
    named = pages(spark, sf).select(
        F.floor(F.col("page_id") / ZIP_PAGES).alias("archive"),
        F.concat(F.col("page_id").cast("string"), F.lit("/index.HTML")).alias("path"),
        "html",
    )
    named.repartition("archive").sortWithinPartitions("archive").foreachPartition(lambda rows, place=qualified(spark, out): _zip_rows(rows, place))
    return read_zip(spark, out).select("path", "content")


def _zip_rows(rows, out: str) -> None:
    import itertools
    import uuid
    import zipfile

    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(out)
    store.create_dir(root, recursive=True)
    for archive, group in itertools.groupby(rows, key=lambda r: r["archive"]):
        draft = f"{root}/{archive}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(draft) as stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
            for r in group:
                z.writestr(r["path"], r["html"])
            z.writestr("../escape.html", "x")
            z.writestr("note.txt", "x")
        store.move(draft, f"{root}/{archive}.zip")  # a retried task replaces the whole archive at once


@query
def docs_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "docs")
    write_docs(pages(spark, sf).select(U.host_of("url").alias("host"), "url", "html"), out)
    return spark.read.parquet(out).select("host", "url", "html")


@query
def parts_files(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "parts")
    docs = documents(spark, sf)
    write_parts(P.placed_texts(docs, combine(docs, 50_000).assigned, 50_000), out)
    return read_markdown(spark, out).select(F.col("path").alias("file"), T.word_count("content").alias("all_words"))


@query
def report_json(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "report")
    write_report(reports(spark, sf), out)
    return R.report_items(read_report(spark, out)).select("step", "url", "status", "error", F.col("time").cast("string").alias("time"))


@query
def crawl_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return seeds(spark, url_variants(spark, sf).select(F.col("u").alias("url"), (F.col("page_id") * 100 + F.col("v")).alias("pos")))


# --- URL functions ------------------------------------------------------------


@query
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return url_variants(spark, sf).select("page_id", "v", U.normalize_url("u").alias("normal"))


@query
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    return url_variants(spark, sf).select("page_id", "v", U.url_parts("u").alias("p")).select("page_id", "v", "p.*")


@query
def url_encode_path(spark: SparkSession, sf: str) -> DataFrame:
    hrefs = pages(spark, sf).select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n", "path"))
    return hrefs.select("page_id", "n", U.encode_path("path").alias("encoded"), U.canonical_path(F.concat("path", F.lit("/(%41%c3)"))).alias("canonical"))


@query
def url_resolve(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.array(*[F.lit(h) for h in HREFS])
    return (
        pages(spark, sf)
        .select("page_id", U.normalize_url("url").alias("base"), F.posexplode(refs).alias("h", "href"))
        .select("page_id", "h", U.resolve_href("base", "href").alias("resolved"))
    )


@query
def url_in_scope(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.array(*[F.lit(h) for h in HREFS])
    base = U.normalize_url(F.regexp_replace("url", r"/[^/]*$", "/"))
    rows = pages(spark, sf).select("page_id", base.alias("base"), U.normalize_url("url").alias("own"), F.posexplode(refs).alias("h", "href"))
    target = rows.select("page_id", "h", "base", U.resolve_href("own", "href").alias("target"))
    return target.filter("target is not null").select("page_id", "h", U.in_scope("base", "target").alias("inside"))


@query
def crawl_scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    return L.scope_filter(L.extract_links(site(spark, sf)), SEED).select("src_url", "dst_url", "pos")


@query
def url_filename(spark: SparkSession, sf: str) -> DataFrame:
    return url_variants(spark, sf).select("page_id", "v", U.url_to_filename(U.normalize_url("u")).alias("filename"))


@query
def url_cache_key(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", U.cache_key("url").alias("cache_key"))


# --- text and paths -----------------------------------------------------------


def spaced(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with Unicode white space and runs of newlines put in."""
    text = F.replace("text", F.lit(". "), F.lit(".\u00a0\u3000\n\n\n\n"))
    text = F.replace(text, F.lit(" a"), F.lit("\u0085a"))
    return table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.concat(F.lit("\u2003\n"), text, F.lit("\u00a0\n")).alias("text")
    )


@query
def text_word_count(spark: SparkSession, sf: str) -> DataFrame:
    return spaced(spark, sf).select("doc_id", T.word_count("text").alias("words"))


@query
def text_tidy_newlines(spark: SparkSession, sf: str) -> DataFrame:
    return spaced(spark, sf).select("doc_id", T.tidy_newlines("text").alias("tidy"))


@query
def path_md(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", T.md_path(U.url_to_filename("url")).alias("path"), T.md_path(F.substring_index("url", "/", 3)).alias("host_path"))


@query
def path_part_name(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        T.part_path(F.concat(F.lit("/out/"), F.col("source"), F.lit(".x/combined.md")), F.col("doc_id")).alias("numbered"),
        T.part_path(F.col("source"), F.col("doc_id"), F.col("lang") == "en").alias("maybe"),
    )


def walk_paths(spark: SparkSession, sf: str) -> DataFrame:
    forms = F.array(F.col("path"), F.regexp_replace("path", "/", "-"), F.regexp_replace("path", "/[^/]*$", ".md"))
    return documents(spark, sf).select(F.explode(forms).alias("path")).distinct()


@query
def path_walk_order(spark: SparkSession, sf: str) -> DataFrame:
    from webquire.operators.ranking import ranked

    return ranked(walk_paths(spark, sf), T.path_order_key("path"), name="walk").df.select("path", F.col("rank").alias("nth"))


@query
def text_split_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.split_list("text"), "|").alias("items"), F.size(T.split_list("text")).cast("bigint").alias("n"))


@query
def html_unescape(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.col("html"), F.lit("&#65;&#x42;&amp;lt;&nosuch;&"))
    return pages(spark, sf).select("page_id", T.unescape_html(text).alias("text"))


# --- HTML ---------------------------------------------------------------------


@query
def html_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return H.html_tokens(shaped_pages(spark, sf, dealt=False), "key").select("key", "pos", "kind", "tag", F.sha2("token", 256).alias("token_hash"))


@query
def html_attrs(spark: SparkSession, sf: str) -> DataFrame:
    attrs = H.html_attrs(H.html_tokens(shaped_pages(spark, sf, dealt=False), "key"))
    return attrs.select("key", "pos", "tag", F.explode("attrs").alias("name", "value"))


@query
def html_elements(spark: SparkSession, sf: str) -> DataFrame:
    return H.html_elements(shaped_pages(spark, sf), "key").select("key", "tag", "open_pos", "close_pos")


@query
def html_main_content(spark: SparkSession, sf: str) -> DataFrame:
    return H.main_content(shaped_pages(spark, sf), "key")


def _left(tokens: DataFrame) -> DataFrame:
    return tokens.filter("kind <> 'eof'").select("key", "pos", "kind", "tag")


@query
def html_strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _left(H.content_tokens(shaped_pages(spark, sf), "key", strip_tags="nav, footer", non_content=False))


@query
def html_strip_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _left(H.content_tokens(shaped_pages(spark, sf), "key", strip_classes=["ad"], media=False, non_content=False, region=False))


# entries that are more than names: compounds, inside of, child of, attributes
SELECTORS = ("div.ad", "section > article", "article ul li.ad", "main > svg", "body > footer", "[role=main] > h1", "p.x.ad")


@query
def html_strip_selectors(spark: SparkSession, sf: str) -> DataFrame:
    return _left(H.content_tokens(shaped_pages(spark, sf), "key", strip_tags=list(SELECTORS), media=False, non_content=False))


@query
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return H.html_text(shaped_pages(spark, sf), "key", strip_tags="nav", strip_classes="ad")


# --- links and crawl ----------------------------------------------------------


@query
def links_extract(spark: SparkSession, sf: str) -> DataFrame:
    return L.extract_links(pages(spark, sf)).groupBy("src_url", "dst_url").agg(F.min("pos").alias("pos"), F.count("*").alias("n"))


@query
def link_edges(spark: SparkSession, sf: str) -> DataFrame:
    return L.link_edges(site(spark, sf))


@query
def links_dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    return L.dedup_first(L.extract_links(site(spark, sf)), "dst_url", "src_url")


@query
def frontier_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    links = L.extract_links(site(spark, sf))
    visited = site(spark, sf).select("url")
    return L.unvisited(links, visited)


@query
def frontier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    frontier = L.extract_links(site(spark, sf)).select(F.col("dst_url").alias("url")).distinct()
    return L.frontier_lookup(frontier, site(spark, sf))


def _cache(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the pages that are complete."""
    return pages(spark, sf).filter(F.col("html").contains("</html>")).select(U.cache_key("url").alias("cache_key")).distinct()


@query
def cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    return L.cache_hits(pages(spark, sf).select("page_id", "url"), _cache(spark, sf))


@query
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return L.cache_misses(pages(spark, sf).select("page_id", "url"), _cache(spark, sf))


@query
def crawl_bfs(spark: SparkSession, sf: str) -> DataFrame:
    return crawl(site(spark, sf), SEED)


@query
def crawl_max_pages(spark: SparkSession, sf: str) -> DataFrame:
    return crawl(site(spark, sf), SEED, max_pages=40)


@query
def crawl_retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    failed = L.frontier_lookup(
        L.extract_links(site(spark, sf)).groupBy(F.col("dst_url").alias("url")).agg(F.count("*").alias("n")), site(spark, sf)
    ).filter("status = 'error'")
    return crawl_retry(site(spark, sf), failed.select("url", F.col("url").alias("pos"))).select("url", "crawl_order", "status", "error")


@query
def filename_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return L.filename_collisions(pages(spark, sf), U.url_to_filename("url"))


@query
def pages_last_write(spark: SparkSession, sf: str) -> DataFrame:
    return L.last_write(pages(spark, sf), U.url_to_filename("url"), "page_id")


# --- reports ------------------------------------------------------------------


@query
def outcome_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = outcomes(spark, sf)
    saved = rows.filter("status = 'ok'").select("step", "url", "status")
    return R.outcome_union(saved, rows.filter("status = 'error'").select("step", "url", "status", "error"))


@query
def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.run_counts(outcomes(spark, sf))


@query
def report_nested(spark: SparkSession, sf: str) -> DataFrame:
    nested = reports(spark, sf).select("version", F.explode("steps").alias("s"))
    return nested.select("version", "s.step", F.size("s.urls").cast("bigint").alias("n_urls"), F.array_join(F.transform("s.urls", lambda u: u["url"]), "\n").alias("url_list"))


@query
def report_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = R.report_steps(outcomes(spark, sf))
    return steps.withColumns({c: F.col(c).cast("string") for c in ("start_time", "end_time")})


@query
def report_items(spark: SparkSession, sf: str) -> DataFrame:
    return R.report_items(reports(spark, sf)).select("step", "url", "status", "error", F.col("time").cast("string").alias("time"))


@query
def report_failed(spark: SparkSession, sf: str) -> DataFrame:
    return R.failed_counts(reports(spark, sf))


@query
def retry_failed(spark: SparkSession, sf: str) -> DataFrame:
    return R.retry_items(pages(spark, sf).select("page_id", "url"), reports(spark, sf), "crawl")


# --- packing ------------------------------------------------------------------


@query
def combine_parts(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("words", T.word_count("content"))
    return P.assign_parts(docs, 3_000, "source").select("grp", "path", "words", "part")


@query
def combine_parts_global(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("words", T.word_count("content"))
    return P.assign_parts(docs, 5_000).select("path", "words", "part")


@query
def combine_content(spark: SparkSession, sf: str) -> DataFrame:
    return combine(documents(spark, sf), 3_000, "source").parts


CHUNK = 2_000


@query
def combine_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a source as one part without a cap, in chunks; many documents are longer than one."""
    return combine(documents(spark, sf), None, "source", chunk_bytes=CHUNK).chunks


@query
def combine_conversations(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.format_string("%012d/%06d.md", "conv_id", "turn").alias("path"), F.col("text").alias("content"), "conv_id"
    )
    return combine(turns, 100, "conv_id").parts


@query
def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return combine(documents(spark, sf), 3_000, "source").summary


@query
def corpus_by_host(spark: SparkSession, sf: str) -> DataFrame:
    return combine(by_host(spark, sf), 1_000, "host").summary


# --- Markdown -----------------------------------------------------------------


@query
def md_render(spark: SparkSession, sf: str) -> DataFrame:
    return M.to_markdown(H.content_tokens(shaped_pages(spark, sf), "key"), "key").select("key", "markdown")


def _markdown(spark: SparkSession, sf: str, *edits: tuple[str, str]) -> DataFrame:
    html = F.col("html")
    for old, new in edits:
        html = F.regexp_replace(html, old, new)
    return M.convert(pages(spark, sf).select("page_id", html.alias("html")))


def _lines(md: DataFrame, pattern: str) -> DataFrame:
    return md.select("page_id", F.posexplode(F.regexp_extract_all("markdown", F.lit(pattern), F.lit(0))).alias("nth", "line"))


@query
def md_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(_markdown(spark, sf, ("<(/?)h1>", "<$1h3>")), r"(?m)^#+ [^\n]*$")


@query
def md_links(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(_markdown(spark, sf, ("</?article>", "")), r"\[[^\]]*\]\([^)]*\)")


@query
def md_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(_markdown(spark, sf, ("</?article>", ""), ("<(/?)ul>", "<$1ol>")), r"(?m)^\d+\. [^\n]*$")


@query
def md_inline(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, ("<b>", "<em>x</em> <code>y</code> <strong>z </strong>")).select("page_id", "markdown")


@query
def md_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _markdown(spark, sf, ("<b>", "<hr>"), ("<h1>", "<blockquote>"), ("</h1>", "</blockquote><pre>code *x*\n</pre>")).select("page_id", "markdown")


@query
def md_dropped(spark: SparkSession, sf: str) -> DataFrame:
    everything = _left(H.content_tokens(shaped_pages(spark, sf), "key", region=False, media=False))
    return everything.groupBy("key").agg(F.count("*").alias("kept"), F.count_if(F.col("kind") == "text").alias("texts"))


@query
def convert_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, and next to each one a page that could not be fetched."""
    found = pages(spark, sf).select("page_id", U.url_to_filename("url").alias("file"), "html")
    source = found.unionByName(found.select((-1 - F.col("page_id")).alias("page_id"), "file", F.lit(None).cast("string").alias("html")))
    return M.convert(source, "nav,footer", "ad", path="file")


def _store(spark: SparkSession, sf: str) -> DataFrame:
    """The linked site as a fetched store: the pages that are cut off have failed with an error of their own."""
    cut_off = ~F.col("html").contains("</html>")
    return site(spark, sf).select(
        "url", F.lit(None).cast("string").alias("final_url"), F.when(~cut_off, F.col("html")).alias("html"), F.when(cut_off, "connection lost").alias("error")
    )


@query
def crawl_stored_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Each URL of the site, looked up in a store that keeps the errors of failed fetches."""
    frontier = L.extract_links(site(spark, sf)).select(F.col("dst_url").alias("url")).distinct()
    return L.frontier_lookup(frontier, _store(spark, sf), error="error")


@query
def pipeline_report_items(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl step of the pipeline's written report."""
    built = build_corpus(site(spark, sf), SEED, strip_tags="nav,footer", strip_classes="ad", max_words=5_000, report_path=work_path(spark, "report"))
    return R.report_items(built.report).filter("step = 'crawl'").select("step", "url", "status", "error")


@query
def retry_from_report(spark: SparkSession, sf: str) -> DataFrame:
    """What failed in a crawl report, fetched again from the site."""
    failed = crawl_stored_errors(spark, sf).select(F.lit("crawl").alias("step"), "url", "status", "error", F.to_timestamp(F.lit(RUN_TIME)).alias("time"))
    return retry_report(site(spark, sf), R.build_report(failed)).select("url", "crawl_order", "status", "error")


@query
def retry_convert_items(spark: SparkSession, sf: str) -> DataFrame:
    """The files whose conversion a report lists as failed, converted again."""
    files = last_pages(spark, sf)
    cut_off = ~F.col("content").contains("</html>")
    items = files.select(
        F.lit("convert").alias("step"), F.col("path").alias("url"), F.when(cut_off, "error").otherwise("ok").alias("status"),
        F.when(cut_off, "cut off").alias("error"), F.to_timestamp(F.lit(RUN_TIME)).alias("time"),
    )
    return retry_convert(files, R.build_report(items), "nav,footer", "ad")


def grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose paths repeat across their sources."""
    by_id = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select(
        F.concat((F.row_number().over(by_id) % 10).cast("string"), F.lit("/"), F.row_number().over(by_id).cast("string"), F.lit(".md")).alias("path"),
        F.col("text").alias("content"),
        "source",
    )


@query
def combine_same_paths(spark: SparkSession, sf: str) -> DataFrame:
    return combine(grouped(spark, sf), 3_000, "source").parts


@query
def corpus_build(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl, convert and combine the linked site; one row per part."""
    built = build_corpus(site(spark, sf), SEED, strip_tags="nav,footer", strip_classes="ad", max_words=5_000)
    return built.parts.select("part", "file", "words", "files", "content")


# --- streaming ----------------------------------------------------------------


def page_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The pages as a stream; the table may be one file or a folder of files, which a pattern finds alike."""
    return spark.readStream.schema("page_id bigint, url string, html string").parquet(f"{sf}/pages.parque[t]")


@query
def stream_converted(spark: SparkSession, sf: str) -> DataFrame:
    out = work_path(spark, "stream")
    stream_convert(page_stream(spark, sf), out, work_path(spark, "state"), "nav,footer", "ad", "page_id", "html", None).awaitTermination()
    return spark.read.parquet(out).select("page_id", "path", "markdown", "status", "error")


@query
def stream_recent_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same with bounded state; one batch, so all links are within the delay."""
    out, state = work_path(spark, "stream"), work_path(spark, "state")
    timed = page_stream(spark, sf).withColumn("seen", F.to_timestamp(F.lit(RUN_TIME)))
    links = stream_links(timed, event_time="seen", delay="1 hour").select("dst_url")
    links.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


@query
def stream_first_links(spark: SparkSession, sf: str) -> DataFrame:
    out, state = work_path(spark, "stream"), work_path(spark, "state")
    links = stream_links(page_stream(spark, sf))
    links.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out)


# bytes of HTML in one file of a stream of pages
FILE_BYTES = 16 << 20


@query
def stream_discovered(spark: SparkSession, sf: str) -> DataFrame:
    """The crawl of the linked site, whose pages come in files in an order of no meaning."""
    store, out = work_path(spark, "arriving"), work_path(spark, "found")
    # three arrivals of two files, or of as many times two as keep a file, and so a task, from growing with the table
    times = max(1, -(-H.html_bytes(pages(spark, sf)) // (6 * FILE_BYTES)))
    site(spark, sf).repartitionByRange(6 * times, F.md5("url")).write.parquet(store)
    coming = spark.readStream.schema("url string, html string").option("maxFilesPerTrigger", 2 * times).parquet(store)
    query = stream_discovery(coming, SEED, out, work_path(spark, "state"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return discovered(spark, out)
