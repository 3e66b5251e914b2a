"""Registered queries against their DuckDB statements on the smallest tables (a cross-section; check.py runs all)."""

import pytest
from check import compare, connect
from conftest import SF

from webquire.oracles import ORACLES
from webquire.queries import QUERIES

SECTION = ("url_resolve", "html_unescape", "html_strip_tags", "link_edges", "combine_content", "report_nested", "md_links")


def test_every_statement_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", SECTION)
def test_statement(spark, name):
    ok, note = compare(spark, connect(SF), name, SF)
    assert ok, note
