"""Periodic runs against a brute-force search of every lag."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SF, table
from webquire.llm import periodic_runs as pr
from webquire.llm.queries import LLM_QUERIES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every maximal stretch with a period, whose smallest period it is, long enough."""
    out = []
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q) and not any(all(w[t] == w[t + p] for t in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {t for s, length, q in runs for t in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)),
        sha(" ".join(x for t, x in enumerate(w) if t not in gone)),
    )


def numbered(w):
    seen = {}
    return np.array([seen.setdefault(x, len(seen)) for x in w], dtype=np.int64)


def periodic_text(r, alphabet, parts):
    """Random words with copies of random blocks, nested, cut anywhere."""
    w = []
    for _ in range(parts):
        block = [r.randrange(alphabet) for _ in range(r.randint(1, 40))]
        if r.random() < 0.5:
            inner = [r.randrange(alphabet)] * r.randint(1, 30)
            block += inner * r.randint(1, 3)
        stretch = block * r.randint(1, 6)
        w += stretch[: r.randint(1, len(stretch))]
    return w


@pytest.mark.parametrize("alphabet", [1, 2, 3, 5, 50])
def test_runs_against_every_lag(alphabet):
    r = random.Random(alphabet)
    total = 0
    for _ in range(150):
        w = periodic_text(r, alphabet, r.randint(1, 7))
        expected = brute_runs(w)
        total += len(expected)
        assert pr.find_runs(numbered(w)) == expected
    assert total > 100


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.integers(1, 9), st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_repeated_blocks(block, copies, rest):
    w = rest[:20] + block * copies + rest
    assert pr.find_runs(numbered(w)) == brute_runs(w)


def test_grams_that_occur_twice_in_a_period():
    """Every short gram of the period recurs inside it, so the next occurrence is not one period on."""
    r = random.Random(5)
    for _ in range(40):
        x, y = [r.randrange(3) for _ in range(r.randint(16, 40))], [r.randrange(3) for _ in range(r.randint(0, 3))]
        w = (x + x + y + x + [7]) * 4 + [9] + (x + x + y) * 5
        assert pr.find_runs(numbered(w)) == brute_runs(w)


def test_long_texts_are_quick():
    for w in (np.zeros(400_000, dtype=np.int64), np.arange(400_000) % 1_000, np.tile(np.concatenate([np.zeros(100, dtype=np.int64), [1]]), 4_000)):
        (run,) = [x for x in pr.find_runs(w) if x[1] == len(w)]
        assert run[2] == {0: 1, 1: 1000, 2: 101}[0 if not w.any() else 1 if w[1] else 2]


def test_words_are_cut_the_same_in_pieces(monkeypatch):
    text = " \n".join(f"w{i % 7}ü" for i in range(500))
    whole = pr._numbered(text)
    monkeypatch.setattr(pr, "PIECE", 5)
    again = pr._numbered(text)
    assert whole[1] == again[1] and whole[0].tolist() == again[0].tolist()


def test_query_against_brute_force(spark):
    rows = table(spark, "documents").select("doc_id", "text").collect()
    got = LLM_QUERIES["op13_periodic_runs"](spark, SF)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    found = Counter(tuple(r) for r in got.collect())
    assert found == Counter(brute_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > 5


def test_odd_rows(spark, odd, none):
    got = pr.periodic_runs(odd).collect()
    expected = Counter((r.doc_id, len(WORDS.findall(r.text or ""))) for r in odd.collect())
    assert Counter((r.doc_id, r.n_words) for r in got) == expected
    (repeated,) = [r for r in got if r.doc_id == 8 and r.n_words == 36]
    assert [tuple(x) for x in repeated.runs] == [(0, 36, 12)] and len(repeated.collapsed.split(" ")) == 12
    (single,) = [r for r in got if r.doc_id == 9]
    assert [tuple(x) for x in single.runs] == [(0, 70, 1)]
    assert pr.periodic_runs(none).count() == 0
    text_ids = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert pr.periodic_runs(text_ids, rewrite=pr.repeated_tail).count() == odd.count()


def test_strongest_breaks_ties(spark):
    df = spark.createDataFrame([([(5, 40, 10), (2, 80, 20), (1, 30, 10)],), ([],), ([(3, 60, 20), (3, 30, 10)],)], f"runs array<{pr.RUN}>")
    assert [r.b and tuple(r.b) for r in df.select(pr.strongest(F.col("runs")).alias("b")).collect()] == [(2, 80, 20), None, (3, 30, 10)]
