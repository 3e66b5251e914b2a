"""Source divergences against a brute-force sum over all groups and kept terms."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, SF, table
from webquire.llm import source_divergence as sd
from webquire.llm.queries import LLM_ORACLES, LLM_QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs=10, listed=10):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    counts, docs, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(lower(text or ""))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
        whole[lang].update(terms)
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        v = len(kept)
        groups = sorted(s for lg, s in counts if lg == lang)

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 2) // (total + 2 * v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in groups}, shares(whole[lang])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        values = defaultdict(list)
        for a, b in permutations(groups, 2):
            values[a, "pair"].append((-sum(f(p[a][t], p[b][t]) for t in kept), b.encode()))
        for a in groups:
            values[a, "term"] = [(-f(p[a][t], q[t]), t.encode()) for t in kept if counts[lang, a][t] and p[a][t] > q[t]]
        for (a, part), found in values.items():
            ranked = sorted(found)[: listed if part == "term" else None]
            out += [(lang, a, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(ranked, 1)]
    return Counter(out)


def test_query_against_brute_force_and_statement(spark):
    rows = table(spark, "documents").select("text", "lang", "source").collect()
    got = LLM_QUERIES["op11_source_divergence"](spark, SF)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    found = Counter(tuple(r) for r in got.collect())
    assert found == brute([tuple(r) for r in rows])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert found == Counter(con.execute(LLM_ORACLES["op11_source_divergence"]).fetchall())


@pytest.mark.parametrize("blocks", [(1, 7), (3, 50), (32, 2_048)])
def test_cells_of_any_size(spark, blocks):
    """Many sources, one of which has a third of the rows; the cells' bounds do not change the result."""
    docs = table(spark, "documents").withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("s"), F.col("doc_id") % 11)).otherwise("hot"))
    expected = brute([tuple(r) for r in docs.select("text", "lang", "source").collect()], 4, 3)
    got = sd.source_divergence(docs, min_docs=4, listed=3, group_block=blocks[0], term_block=blocks[1])
    assert Counter(tuple(r) for r in got.collect()) == expected


def test_odd_rows(spark, odd, none):
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    for least in (1, 2, 10):
        assert Counter(tuple(r) for r in sd.source_divergence(odd, min_docs=least).collect()) == brute(rows, least)
    assert sd.source_divergence(none).count() == 0


def test_no_shares_without_kept_terms(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "x", 1), (2, "", "en", "y", 1), (3, None, None, None, 1)], DOCS)
    assert sorted(tuple(r) for r in sd.source_divergence(docs).collect()) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_large_counts_stay_exact(spark):
    n, total = 3 * 10**18 + 1, 8 * 10**18
    got = spark.range(1).select(sd._share(F.lit(n).cast("long"), F.lit(total).cast("long"), F.lit(5).cast("long")).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 10)


def test_terms_of_pieces(monkeypatch):
    text = "Ärger THE the\x00x1y_z 日本 " * 50
    whole = [t for part in sd._pieces(text.encode()) for t in part]
    monkeypatch.setattr(sd, "PIECE", 3)
    assert [t for part in sd._pieces(text.encode()) for t in part] == whole
    assert Counter(t.decode() for t in whole) == Counter(TERM.findall("Ärger the the\x00x1y_z 日本 " * 50))
