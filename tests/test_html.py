from conftest import SF
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webquire.operators.html import html_attrs, html_text, html_tokens, main_content
from webquire.operators.links import extract_links
from webquire.operators.markdown import convert

# fixed values: words and links of the small pages, given by what has to be matched
RICH = """<html><head><title>T</title></head><body><nav>Navigation</nav><!-- <main>no</main> --><script>"<main>"</script>
<main>
  <article>
    <h1>Hello <em>you</em></h1><noscript><a href=x>no</a></noscript>
    <p>World<nav>gone</nav> it's <a title="a>b" href='/x?a&amp;b' HREF=z>x</a><div class="c ad k">ad<div>q</div></div> done <img src=x>.</p>
  </article>
</main>
</body></html>"""
PAGES = [
    (1, RICH), (2, None), (3, ""), (4, "<div role='main'>r<b>x</div>z"), (5, "plain <"),
    (6, "<article>a</article><main><div><article>b</article></div></main>"),
]
MARKDOWN = """# Ti *tle*

Some **bold** text & *it* a_b \\_x\\_ 2\\*3 [link](/x%20y "T")  
next

- one
- two

  more
  - n1
  - n2
- three `` a*`b `` `x`

1. a
2. b

   > q1

> quote a
>
> quote b

> second

* * *

after

```py
def f():
    return 1
```

### [Card](/card)

[desc](/card)

\\# not heading

1\\. x
"""
MARKED = """<html><body><main><h1>Ti <em>tle</em></h1><p>Some <b>bold </b>text &amp; <i>it</i> a_b _x_ 2*3 <a href="/x y" title="T">link</a><br>next<img src=q></p>
<ul><li>one</li><li><p>two</p><p>more</p><ul><li>n1<li>n2</ul></li><li>three <code>a*`b</code> <code>x</code></li></ul><ol><li>a</li><li>b<blockquote>q1</blockquote></li></ol>
<blockquote><p>quote a</p><p>quote b</p></blockquote><blockquote>second</blockquote><hr>after
<pre><code class="language-py">def f():
    return 1
</code></pre><a href="/card"><h3>Card</h3><p>desc</p></a><noscript>no</noscript><p># not heading</p><p>1. x</p></main></body></html>"""


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, html string")


def test_region_and_strip(spark):
    tiers = {r.page_id: r.tier for r in main_content(frame(spark)).collect()}
    assert tiers == {1: 1, 2: 6, 3: 6, 4: 3, 5: 6, 6: 1}
    text = {r.page_id: " ".join(r.text.split()) for r in html_text(frame(spark), strip_tags="nav", strip_classes="ad").collect()}
    assert text == {1: "Hello you World it's x done .", 2: "", 3: "", 4: "rx", 5: "plain <", 6: "b"}


def test_attributes(spark):
    rows = html_attrs(html_tokens(frame(spark))).filter("tag = 'a' and kind = 'start'").collect()
    assert [r.attrs for r in rows] == [{"title": "a>b", "href": "/x?a&b"}]


def test_links(spark):
    page = '<a href="/page1">1</a><a href="https://external.com/page">E</a><a href="/page1">D</a><a href="#f">F</a><link href=s.css><a href>'
    rows = extract_links(spark.createDataFrame([("https://example.com/", page)], "url string, html string")).orderBy("pos").collect()
    assert [r.dst_url for r in rows] == [
        "https://example.com/page1", "https://external.com/page", "https://example.com/", "https://example.com/s.css",
    ]


def test_tokens_are_lossless_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "")
    back = html_tokens(pages).groupBy("page_id").agg(joined.alias("again"))
    assert pages.join(back, "page_id").filter("html <> again").count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<>/!-ab =\"'script\n&", min_size=1, max_size=60), min_size=1, max_size=20))
def test_tokens_are_lossless(spark, texts):
    rows = html_tokens(frame(spark, list(enumerate(texts)))).collect()
    back = {}
    for r in sorted(rows, key=lambda r: (r.page_id, r.pos)):
        back[r.page_id] = back.get(r.page_id, "") + r.token
    assert back == dict(enumerate(texts))


def test_markdown(spark):
    rows = {r.page_id: r for r in convert(frame(spark, [(1, MARKED), (2, None), (3, ""), (4, "<p>First</p>\n\n\n\n<p>Second</p>")])).collect()}
    assert rows[1].markdown == MARKDOWN
    assert (rows[2].markdown, rows[2].status) == (None, "error")
    assert rows[3].markdown == "\n"
    assert rows[4].markdown == "First\n\nSecond\n"
    assert rows[1].path == "1.md" and rows[1].status == "ok"


def test_stripping_inside_the_region(spark):
    row = convert(frame(spark, PAGES[:1]), strip_tags=["nav"], strip_classes="ad").collect()[0]
    assert "gone" not in row.markdown and "ad" not in row.markdown and '[x](/x?a&b "a>b")' in row.markdown
