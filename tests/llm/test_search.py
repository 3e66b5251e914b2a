"""Exact top-k search against all inner products."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SF, table
from webquire.llm import impact_search as ms
from webquire.llm.queries import LLM_ORACLES, LLM_QUERIES


def brute(rows, top=5, every=50):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(usable):
        if i is None or i % every:
            continue
        found = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(usable) if a != b]
        out += [(i, rank, j, -minus) for rank, (minus, _, _, j) in enumerate(sorted(found, key=lambda f: f[:3])[:top], 1)]
    return Counter(out)


def test_query_against_brute_force_and_statement(spark):
    rows = [tuple(r) for r in table(spark, "embeddings").select("vec_id", "embedding").collect()]
    got = LLM_QUERIES["op12_impact_search"](spark, SF)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    found = Counter(tuple(r) for r in got.collect())
    assert found == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert found == Counter(con.execute(LLM_ORACLES["op12_impact_search"]).fetchall())


SCHEMA = "vec_id long, embedding array<double>, score string, rank string, v string, id string, block int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x", 0) for i, v in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("block,group", [(8_192, 8_192), (7, 3), (40, 8_192)])
def test_blocks_and_groups_of_any_size(spark, block, group):
    """Clusters, one vector that a third of the rows share, ties, and copies of query rows."""
    r = random.Random(block)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for i in range(200)]
    rows += [(1_000 + i, centres[0]) for i in range(100)] + [(r.randrange(30), [float(r.randint(-1, 1)) for _ in range(4)]) for _ in range(60)]
    rows += [rows[0], rows[0], rows[50], (50, centres[1]), (None, centres[2]), (None, centres[2])]
    got = ms.top_products(frame(spark, rows), F.col("vec_id") % 10 == 0, 4, block=block, group=group)
    assert Counter(tuple(x) for x in got.collect()) == brute(rows, 4, 10)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [1.0]), (50, []), (100, None), (1, [nan]), (2, [inf, 1.0]), (3, [-inf]), (4, [None, 1.0]), (5, [0.0, 0.0, 0.0]),
        (6, [-0.001, 0.001]), (None, [3.0, 3.0, 3.0]), (-50, [1.0, 2.0, 0.0]), (7, []),
    ]
    got = [tuple(x) for x in ms.top_products(frame(spark, rows), F.col("vec_id") % 50 == 0).collect()]
    assert Counter(got) == brute(rows)
    assert ms.top_products(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ms.top_products(frame(spark, rows), F.col("vec_id") % 50 == 11).count() == 0
    alone = ms.top_products(frame(spark, rows[:1]), F.col("vec_id") == 0)
    assert alone.count() == 0
    text_ids = frame(spark, rows).withColumn("vec_id", F.concat(F.lit("k"), "vec_id"))
    assert ms.top_products(text_ids, F.col("vec_id") == "k5").count() == 5


def test_large_components(spark):
    rows = [(0, [1e300, -1e300, 1.0]), (1, [1e300, 1e300, 0.0]), (2, [1e5, -1e5, 3.0]), (3, [0.5, 0.25, 1e30])]
    got = {(r.rank, r.vec_id): r.score for r in ms.top_products(frame(spark, rows), F.col("vec_id") == 0).collect()}
    top = ms.LARGEST
    assert got == {(1, 2): 2 * top * 25_600_000 + 768 * 256, (2, 3): top * 128 - top * 64 + 256 * top, (3, 1): 0}


def test_stops_before_the_last_postings_on_proof():
    """Near and far vectors: the bound leaves few, and those hold the best."""
    r = np.random.default_rng(2)
    vectors, queries = r.integers(-100, 100, (500, 32)), r.integers(-100, 100, (4, 32))
    for cut_at in (40, 20, 10):
        read = np.where(np.abs(vectors) >= cut_at, vectors, 0)
        rest = np.sqrt(((vectors - read) ** 2).sum(axis=1))
        lengths = np.sqrt((queries**2).sum(axis=1))
        can = ms._possible((read @ queries.T).astype(float), rest, lengths, 0.0, 5)
        best = np.argsort(-(vectors @ queries.T), axis=0, kind="stable")[:6]
        assert all(can[best[:, q], q].all() for q in range(4))
    assert can.sum(axis=0).max() < 250


def test_segments_hold_every_component_by_impact(spark):
    rows = [tuple(r) for r in table(spark, "embeddings").select("vec_id", "embedding").collect()]
    index, blocks = ms.impact_index(ms.whole_vectors(table(spark, "embeddings")), block=100)
    assert blocks == -(-len({tuple(math.floor(256 * x) for x in v) for _, v in rows}) // 100)
    parts = defaultdict(list)
    for x in index.collect():
        parts[x.block].append(x)
    found = Counter()
    for segments in parts.values():
        (names,) = [x.names for x in segments if x.level is None]
        highest = {}
        for x in segments:
            if x.level is not None:
                assert len(x.who) == len(set(x.who))
                highest.setdefault(x.level, []).extend(map(abs, x.value))
                found.update((names[w][0], x.dim, value) for w, value in zip(x.who, x.value))
        levels = sorted(highest)
        assert all(max(highest[a]) < min(highest[b]) for a, b in zip(levels, levels[1:]))
    first = {}
    for i, v in sorted(rows):
        first.setdefault(tuple(math.floor(256 * x) for x in v), i)
    assert found == Counter((i, d, x) for v, i in first.items() for d, x in enumerate(v) if x)
