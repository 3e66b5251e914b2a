"""Behaviour at sizes and inputs that the given tables do not reach."""

import io
import time
import zipfile

from pyspark.sql import functions as F

from webquire.operators import html as H
from webquire.operators import report as R
from webquire.operators.links import link_edges
from webquire.operators.packing import assign_parts, placed_texts
from webquire.plans.combine import combine
from webquire.plans.crawl import crawl, crawl_retry, retry_report
from webquire.session import clear_work, cut
from webquire.sources.readers import read_markdown, read_zip
from webquire.sources.writers import write_parts

RUN = "2026-01-01"


def outcomes(spark, n):
    rows = spark.range(n).select(F.format_string("u%06d", "id").alias("url"), F.explode(F.array(F.lit("crawl"), F.lit("convert"))).alias("step"))
    return rows.select("step", "url", F.when(F.col("url").endswith("7"), "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.to_timestamp(F.lit(RUN)).alias("time"))


def test_report_has_one_layout_at_every_size(spark):
    for n in (10, 1_000, 60_000):
        objects = R.build_report(outcomes(spark, n), F.to_timestamp(F.lit(RUN))).select(F.size("steps").alias("steps"), F.col("steps")[0]["step"].alias("step"), F.size(F.col("steps")[0]["urls"]).alias("items"), F.col("steps")[0]["urls"][0]["url"].alias("first")).collect()
        assert {o.steps for o in objects} == {1}
        for step in ("crawl", "convert"):
            sizes = [o.items for o in sorted((o for o in objects if o.step == step), key=lambda o: o.first)]
            assert sizes == [min(R.PAGE_ITEMS, n - k) for k in range(0, n, R.PAGE_ITEMS)]
        assert R.report_items(R.build_report(outcomes(spark, n), F.to_timestamp(F.lit(RUN)))).count() == 2 * n


def test_report_steps_and_retry(spark):
    rows = outcomes(spark, 100)
    assert {(r.step, r.ok, r.skipped, r.error) for r in R.report_steps(rows).collect()} == {("crawl", 90, 0, 10), ("convert", 90, 0, 10)}
    pages = spark.createDataFrame([("http://a.test/x", "<p>x", None), ("http://a.test/y", None, "gone")], "url string, html string, error string")
    failed = spark.createDataFrame([("crawl", "http://a.test/x", "error", "e"), ("crawl", "http://a.test/y", "error", "e"), ("convert", "http://a.test/z", "error", "e")], "step string, url string, status string, error string").withColumn("time", F.to_timestamp(F.lit(RUN)))
    got = retry_report(pages, R.build_report(failed, F.to_timestamp(F.lit(RUN))), error="error").orderBy("url").collect()
    assert [(r.url, r.status, r.error) for r in got] == [("http://a.test/x", "ok", None), ("http://a.test/y", "error", "gone")]


def test_negative_budget_is_no_budget(spark):
    links = "".join(f'<a href="/{i}">x</a>' for i in range(1, 4))
    pages = spark.createDataFrame([("http://a.test/", links)], "url string, html string")
    assert crawl(pages, "http://a.test/", max_pages=-1).count() == 4
    assert crawl(pages, "http://a.test/", max_pages=2).count() == 2
    assert crawl_retry(pages, ["http://a.test/1", "http://a.test/2"], max_pages=-5).count() == 2


def test_redirected_page_resolves_against_its_final_url(spark):
    pages = spark.createDataFrame([("http://a.test/docs", "http://a.test/docs/v2/", '<a href="p">x</a>')], "url string, final_url string, html string")
    assert {r.url for r in crawl(pages, "http://a.test/docs", final_url="final_url").collect()} == {"http://a.test/docs", "http://a.test/docs/v2/p"}


def test_one_target_on_most_links_is_split(spark):
    pages = spark.range(3_000).select(
        F.concat(F.lit("http://a.test/p"), F.col("id").cast("string")).alias("url"),
        F.concat(F.lit('<a href="/p1">home</a><a href="/p'), ((F.col("id") * 7) % 3_100).cast("string"), F.lit('">x</a>')).alias("html"),
    ).repartition(8)
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        edges = link_edges(pages)
        got = {(r.src_url, r.dst_url): r.in_store for r in edges.collect()}
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    expected = {}
    for i in range(3_000):
        for j in (1, i * 7 % 3_100):
            expected[f"http://a.test/p{i}", f"http://a.test/p{j}"] = j < 3_000
    assert got == expected and "skew=true" in plan


def test_groups_with_equal_paths_stay_apart(spark):
    docs = spark.createDataFrame([("index.md", "a one", "x"), ("index.md", "b two", "y")], "path string, content string, grp string")
    parts = combine(docs, 100, "grp").parts.collect()
    assert {(p.grp, p.files, p.content) for p in parts} == {("x", 1, "a one"), ("y", 1, "b two")}


def test_parts_are_streamed_as_they_are_joined(spark, tmp_path):
    docs = spark.range(300).select(F.format_string("%04d.md", F.col("id") % 150).alias("path"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), (F.col("id") % 2).cast("string").alias("g"))
    docs = docs.dropDuplicates(["g", "path"])
    for cap in (None, 40):
        done = combine(docs, cap, "g")
        write_parts(placed_texts(docs, done.assigned, cap, group_by="g"), str(tmp_path / str(cap)))
        assert {(r.path, r.content) for r in read_markdown(spark, str(tmp_path / str(cap))).collect()} == {(f"{p.grp}/{p.file}", p.content) for p in done.parts.collect()}


def test_work_folders_can_be_cleared(spark):
    clear_work(spark)
    kept = cut(spark.range(3), "x")
    assert kept.count() == 3 and clear_work(spark) == 1 and clear_work(spark) == 0


def test_packing_without_a_cap_over_many_blocks(spark):
    docs = spark.range(20_000).select(F.format_string("%06d.md", "id").alias("path"), F.lit(3).alias("words"), F.lit("g").alias("grp")).repartition(8)
    for cap, parts in ((None, 1), (3_000, 20), (10**9, 1), (2, 20_000)):
        assert assign_parts(docs, cap, "grp").agg(F.max("part"), F.count("*")).first()[:] == (parts, 20_000)


def test_damaged_archives_are_rows(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.html", "good " * 100)
        z.writestr("b.html", "other " * 100)
    whole = buffer.getvalue()
    at = whole.index(b"b.html") + 10
    (tmp_path / "good.zip").write_bytes(whole)
    (tmp_path / "entry.zip").write_bytes(whole[:at] + b"\xff\xff\xff" + whole[at + 3 :])
    (tmp_path / "cut.zip").write_bytes(whole[:60])
    got = {(r.archive, r.path, r.content is None, r.error is None) for r in read_zip(spark, str(tmp_path)).collect()}
    assert got == {("good.zip", "a.html", False, True), ("good.zip", "b.html", False, True), ("entry.zip", "a.html", False, True), ("entry.zip", "b.html", True, False), ("cut.zip", None, True, False)}


def test_relative_root_inside_another_name(spark, tmp_path, monkeypatch):
    folder = tmp_path / "checkout" / "out" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("x")
    assert [r.path for r in read_markdown(spark, str(tmp_path / "checkout" / "out")).collect()] == ["sub/a.md"]
    assert [r.path for r in read_markdown(spark, "file://" + str(tmp_path / "checkout" / "out") + "/").collect()] == ["sub/a.md"]


def text(spark, html, **options):
    return H.html_text(spark.createDataFrame([(1, html)], "page_id long, html string"), **options).first()["text"]


def test_stripping_an_unclosed_element_keeps_what_follows(spark):
    cases = {
        '<p class="ad">Ad<p>Real one<h2>T</h2><p>Real two': "Real oneTReal two",
        '<ul><li class="ad">x<li>keep</ul><p>keep2</p>': "keepkeep2",
        '<table><tr><td class="ad">a<td>b<tr><td>c</table><p>after</p>': "bcafter",
        '<ul><li class="ad">x<ul><li>in<li>ner</ul><li>keep</ul>z': "keepz",
        '<dl><dt class="ad">t<dd>d</dl>z': "dz",
        '<div><p class="ad">x</div>keep': "keep",
        '<table><tr class="ad"><td>a<tr><td>b</table>z': "bz",
    }
    assert {k: text(spark, k, strip_classes="ad") for k in cases} == cases


def test_cut_off_tag_is_no_text(spark):
    assert text(spark, '<p>hello <a href="x" class="y') == "hello "
    assert text(spark, "<p>a</") == "a</" or text(spark, "<p>a</") == "a"
    assert text(spark, "<p>x<script src='") == "x"


def test_unterminated_tags_are_linear(spark):
    start = time.time()
    assert text(spark, "<a " * 350_000) == ""
    assert time.time() - start < 30


def test_parts_in_chunks(spark):
    """One part without a cap over many blocks: no row above the bound, and the chunks are the part's text."""
    text = F.concat(F.lit("té€t😀 "), F.repeat(F.lit("xü "), (F.col("id") * 37 % 50).cast("int")))
    docs = spark.range(2_000).select(
        F.format_string("%05d.md", "id").alias("path"), F.when(F.col("id") % 97 == 0, "").when(F.col("id") % 89 == 0, F.repeat(text, 40)).otherwise(text).alias("content"), F.lit("g").alias("grp")
    ).repartition(8)
    for cap, size in ((None, 1_000), (300, 1_000), (None, 64), (None, 1 << 24)):
        done = combine(docs, cap, "grp", chunk_bytes=size)
        whole = {(p.part, p.file): p.content for p in done.parts.collect()}
        chunks = done.chunks.orderBy("part", "chunk_no").collect()
        joined = {}
        for c in chunks:
            joined[c.part, c.file] = joined.get((c.part, c.file), "") + c.content
            assert len(c.content.encode()) < 2 * size + 7
        assert joined == whole and len(whole) == (1 if cap is None else len(whole))
        assert len(chunks) >= sum(len(t.encode()) for t in whole.values()) // (2 * size)


def test_chunks_of_nothing_and_of_unreadable_documents(spark):
    docs = spark.createDataFrame([("a.md", None), ("b.md", "")], "path string, content string")
    assert combine(docs, None).chunks.collect() == [] or [c.content for c in combine(docs, None).chunks.collect()] == [""]
    assert combine(docs.limit(0), None).chunks.count() == 0
