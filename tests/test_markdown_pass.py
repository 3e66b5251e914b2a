"""Markdown is written in one pass over the tokens that ``content_tokens`` has sorted."""

from webquire.operators import html as H
from webquire.operators import markdown as M


def test_the_pass_adds_no_window_no_sort_and_no_shuffle(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<li><b>b</b></ul><p>x"), (2, None)], "page_id long, html string")
    tokens = H.content_tokens(pages, size=1)
    done = M.to_markdown(tokens)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (tokens, done)]
    for node in ("Window [", "Sort [", "Exchange "):
        assert plans[1].count(node) == plans[0].count(node), node
    assert sorted((r.page_id, r.markdown) for r in done.collect()) == [(1, "- a\n- **b**\n\nx\n"), (2, "\n")]


def test_lines_end_as_in_the_other_regular_expressions(spark):
    """A sign at the begin of a line is escaped, also behind a line end that only java.util.regex knows."""
    pages = spark.createDataFrame([(1, "<p>a&#x2028;# b&#x2026;- c<br>1. d</p>")], "page_id long, html string")
    assert M.convert(pages).first().markdown == "a \\# b…- c  \n1\\. d\n"
