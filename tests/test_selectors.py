"""Strip entries that are selectors, and HTML work in proportion to the page."""

import time

import pytest

from webquire.operators import html as H
from webquire.operators.markdown import convert
from webquire.operators.selectors import parse


def left(spark, html, *entries, **options):
    return H.html_text(spark.createDataFrame([(1, html)], "page_id long, html string"), strip_tags=list(entries), **options).first()["text"]


CASES = [
    ("<div class='ad x'>1</div><div class=ad>2</div><p class=ad>3</p>", ["div.ad.x"], "23"),
    ("<main><aside>1</aside><div><aside>2</aside></div></main>", ["main > aside"], "2"),
    ("<main><aside>1</aside><div><aside>2</aside></div></main>", ["main aside"], ""),
    ("<div><div><p>1</p></div><p>2</p></div><p>3</p>", ["div > div > p"], "23"),
    ("<section><ul><li>1<li>2<ul><li>3</ul></ul></section><ul><li>4</ul>", ["section > ul > li > ul"], "124"),
    ("<p id=top>1<p id=Top>2", ["#top"], "2"),
    ("<a rel='next x'>1</a><a rel=next>2</a><a>3</a>", ["a[rel=next]"], "1" + "3"),
    ("<b hidden>1</b><b title='hidden'>2</b>", ["[hidden]"], "2"),
    ("<i title=\"a b\">1</i><i title='a'>2</i>", ["i[title='a b']"], "2"),
    ("<div><b><i>1</b></i></div><i>2</i>", ["div i"], "2"),
    ("<ul><li>1<p>2</ul><p>3", ["li > p"], "13"),
    ("<ul><li>1<p>2</ul><p>3", ["ul * p"], "13"),
    ("<body><article>1<em>2</em></article></body>", ["body > article > em"], "1"),
]


@pytest.mark.parametrize("html,entries,text", CASES)
def test_selectors(spark, html, entries, text):
    assert left(spark, html, *entries) == text


def test_class_entries_may_go_on(spark):
    html = "<div class='a b'>1</div><div class=a>2<p>3</p></div>"
    assert left(spark, html, strip_classes=["a.b", "a > p"]) == "2"


@pytest.mark.parametrize("bad", ["a:hover", "a + b", "a ~ b", "> a", "a >", "a[b^=c]", "::x", "a >> b", "."])
def test_other_syntax_raises(bad):
    with pytest.raises(ValueError, match="not supported"):
        parse(bad)


def test_many_paragraphs_take_time_in_proportion(spark):
    seconds = {}
    for n in (16_000, 64_000):
        pages = spark.createDataFrame([(1, "<ul><li>a" * 3 + "<p>x</p>" * n)], "page_id long, html string")
        start = time.time()
        assert len(H.html_text(pages).first()["text"]) == n + 3
        seconds[n] = time.time() - start
    assert seconds[64_000] < 30 and seconds[64_000] < 8 * seconds[16_000]
    start = time.time()
    assert convert(spark.createDataFrame([(1, "<p>x</p>" * 64_000)], "page_id long, html string")).first()["markdown"].count("x") == 64_000
    assert time.time() - start < 60
