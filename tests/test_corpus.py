import random
import zipfile

import pytest
from pyspark.sql import functions as F

from webquire.operators.packing import assign_parts
from webquire.operators.report import build_report, failed_counts, report_items, retry_items
from webquire.plans.build import build_corpus
from webquire.plans.combine import combine
from webquire.plans.crawl import crawl, crawl_retry
from webquire.sources.readers import read_html, read_report, read_zip
from webquire.sources.writers import write_docs, write_files, write_report
from webquire.streaming.streams import stream_convert, stream_html, stream_links


def fold(docs, cap):
    out, words, part = [], 0, 0
    for w, empty in docs:
        if empty:
            lead = part == 0 or words > cap
            out.append((part + 1 if lead else part, lead))
            continue
        if part == 0 or words + w > cap:
            part, words = part + 1, 0
        words += w
        out.append((part, False))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packing_equals_the_fold(spark, seed):
    rnd = random.Random(seed)
    cap, rows = rnd.choice([5, 15, 50, 1000]), []
    for g in range(3):
        for i in range(rnd.choice([400, 1500]) if g == 0 else rnd.randint(1, 40)):
            empty = rnd.random() < 0.1
            rows.append((f"g{g}", f"d{i % 7}/{i:05d}.md", 0 if empty else rnd.choice([0, 1, 2, 7, 20, rnd.randint(0, cap)]), empty))
    df = spark.createDataFrame(rows, "g string, path string, words bigint, empty boolean")
    got = {(r.grp, r.path): (r.part, r.leading) for r in assign_parts(df, cap, "g", empty="empty").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1].split("/"))
        want.update(zip(((g, r[1]) for r in mine), fold([(r[2], r[3]) for r in mine], cap)))
    assert got == want


def test_equal_documents_never_align(spark):
    df = spark.range(3000).select(F.format_string("%06d.md", "id").alias("path"), F.lit(7).alias("words"))
    got = [r.part for r in assign_parts(df, 50).orderBy("path").collect()]
    assert got == [i // 7 + 1 for i in range(3000)]


def docs(spark, *contents):
    return spark.createDataFrame([(f"{chr(97 + i)}.md", c) for i, c in enumerate(contents)], "path string, content string")


def test_combine(spark):
    done = combine(docs(spark, "# A\n\nContent of A.", "", "# B\n\nContent of B."), 0)
    assert [(r.file, r.content) for r in done.parts.collect()] == [
        ("combined.md", "# A\n\nContent of A.\n\n---\n\n\n\n---\n\n# B\n\nContent of B.")
    ]
    ten = "one two three four five six seven eight nine ten"
    split = combine(docs(spark, ten, ten, None), 15)
    assert sorted(r.file for r in split.parts.collect()) == ["combined-001.md", "combined-002.md"]
    assert [tuple(r) for r in split.summary.collect()] == [("", 3, 20, 2)]
    nothing = combine(docs(spark, "x").limit(0))
    assert nothing.parts.count() == 0 and nothing.summary.count() == 0


def graph(spark, rnd, n):
    links = {i: [rnd.randrange(n + 3) for _ in range(rnd.randint(0, 3))] for i in range(n)}
    url = lambda i: "https://s.test/d" + (f"/{i}" if i else "")
    rows = [(url(i), "".join(f'<a href="{url(j)}">x</a>' for j in out)) for i, out in links.items()]
    return spark.createDataFrame(rows, "url string, html string"), {url(i): [url(j) for j in out] for i, out in links.items()}


@pytest.mark.parametrize("seed,budget", [(1, 0), (2, 7)])
def test_crawl_equals_a_plain_walk(spark, seed, budget):
    pages, links = graph(spark, random.Random(seed), 25)
    queue, order = ["https://s.test/d"], []
    seen = set(queue)
    while queue and not (budget and len(order) >= budget):
        url = queue.pop(0)
        order.append((url, "ok" if url in links else "error"))
        for target in links.get(url, []):
            if target not in seen:
                seen.add(target)
                queue.append(target)
    got = crawl(pages, "https://s.test/d/", budget).orderBy("crawl_order").collect()
    assert [(r.url, r.status) for r in got] == order
    assert [r.crawl_order for r in got] == list(range(1, len(order) + 1))


def test_crawl_edges(spark):
    pages, _ = graph(spark, random.Random(3), 5)
    with pytest.raises(ValueError):
        crawl(pages, "/no-host")
    again = crawl_retry(pages, ["https://s.test/d/4/", "nonsense", "https://s.test/d/4", "https://s.test/gone"])
    assert [(r.url, r.status) for r in again.orderBy("crawl_order").collect()] == [("https://s.test/d/4", "ok"), ("https://s.test/gone", "error")]


def test_report_roundtrip(spark, tmp_path, monkeypatch):
    rows = [("crawl", f"u{i}", "error" if i % 3 == 0 else "ok", "bad" if i % 3 == 0 else None) for i in range(10)] + [("convert", "f", "ok", None)]
    outcomes = spark.createDataFrame(rows, "step string, url string, status string, error string").withColumn("time", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    for size in (100, 3):
        monkeypatch.setattr("webquire.operators.report.PAGE_ITEMS", size)
        reports = build_report(outcomes)
        write_report(reports, str(tmp_path / f"r{size}"))
        back = read_report(spark, str(tmp_path / f"r{size}"))
        assert sorted(map(tuple, report_items(back).drop("time").collect()), key=repr) == sorted(rows, key=repr)
        assert [tuple(r) for r in failed_counts(back).collect()] == [("crawl", 4)]
        items = spark.createDataFrame([("u0",), ("u1",), ("f",)], "url string")
        assert [r.url for r in retry_items(items, back, "crawl").collect()] == ["u0"]


def test_files_and_archives(spark, tmp_path):
    out = str(tmp_path / "tree")
    write_files(spark.createDataFrame([("a.HTML", "A"), ("sub/b.html", "B ü"), ("c.txt", "C")], "path string, content string"), out)
    assert sorted(map(tuple, read_html(spark, out).collect())) == [("a.HTML", "A"), ("sub/b.html", "B ü")]
    for name in ("one", "two"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr("x/p.html", name)
            z.writestr("x/../../up.html", "no")
            z.writestr("note.txt", "no")
    got = sorted(map(tuple, read_zip(spark, str(tmp_path)).collect()))
    assert got == [("one.zip", "x/p.html", "one", None), ("two.zip", "x/p.html", "two", None)]
    write_docs(spark.createDataFrame([("h1", "a"), ("h2", "b")], "host string, doc string"), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 2


def test_build_corpus(spark):
    pages, _ = graph(spark, random.Random(4), 6)
    built = build_corpus(pages.withColumn("html", F.concat("html", F.lit("<p>five words are in here</p>"))), "https://s.test/d", max_words=20)
    ok = {r.step: r.n for r in built.outcomes.filter("status = 'ok'").groupBy("step").agg(F.count("*").alias("n")).collect()}
    assert ok["crawl"] == ok["convert"] > 1
    assert built.parts.agg(F.sum("files")).head()[0] == ok["convert"]
    assert {(c.part, c.content) for c in built.chunks.collect()} == {(p.part, p.content) for p in built.parts.collect()}


def test_streams_equal_batch(spark, tmp_path):
    tree = str(tmp_path / "in")
    pages = [("p1.html", "<p>one</p>"), ("p2.html", "<h1>two</h1>")]
    write_files(spark.createDataFrame(pages, "path string, content string"), tree)
    stream_convert(stream_html(spark, tree), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select(F.element_at(F.split("path", "/"), -1).alias("p"), "markdown").collect()
    assert sorted(map(tuple, got)) == [("p1.md", "one\n"), ("p2.md", "# two\n")]
    spark.createDataFrame([("https://s.test/d", '<a href="/d/1">1</a><a href="/e">e</a><a href="/d/1">1</a>')], "url string, html string").write.parquet(str(tmp_path / "pages"))
    links = stream_links(spark.readStream.schema("url string, html string").parquet(str(tmp_path / "pages")), "https://s.test/d")
    links.writeStream.format("memory").queryName("first_links").trigger(availableNow=True).start().awaitTermination()
    assert [r.dst_url for r in spark.table("first_links").collect()] == ["https://s.test/d/1"]
