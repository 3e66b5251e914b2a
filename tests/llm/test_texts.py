"""Quality rules, token counts, token shards, toxicity and line templates."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import table
from webquire.llm import factorization as fm
from webquire.llm import line_templates as lt
from webquire.llm import quality_cascade as qc
from webquire.llm import token_attribution as ta
from webquire.llm import token_shards as ts
from webquire.llm.tokens import END_OF_TEXT, FOLDER, VOCABULARY, Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def encoder():
    with open(f"{FOLDER}/{VOCABULARY}", "rb") as f:
        return Encoder(f.read())


def brute_quality(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if windows[tuple(words[k : k + 3])] > 1}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_quality_measures(spark, odd):
    for docs in (odd, table(spark, "documents")):
        texts = Counter((r.doc_id, *brute_quality(r.text)) for r in docs.select("doc_id", "text").collect())
        got = qc.quality_cascade(docs).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == texts
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (r.rejected_by is None) and not (r.base_failed and r.kept)


def test_quality_verdict_is_independent_of_the_order(spark):
    docs = table(spark, "documents")
    one = {r.doc_id: r.kept for r in qc.quality_cascade(docs).collect()}
    other = {r.doc_id: r.kept for r in qc.quality_cascade(docs, rules=qc.RULES[::-1], sample_fraction=1.0).collect()}
    alone = {r.doc_id: not (t := qc.Text(r.text or "")).base_failed and not any(x.rejects(t) for x in qc.RULES) for r in docs.collect()}
    assert one == other == alone


def test_quality_order_prefers_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "a b " * 30) for i in range(50)], "doc_id long, text string")

    def slow(t):
        return sum(i * i for i in range(20_000)) < 0

    rules = (qc.Rule("never", slow), qc.Rule("dear", lambda t: sum(i * i for i in range(20_000)) > 0), qc.Rule("cheap", lambda t: True))
    assert qc.profile(docs, "text", rules, 1.0, 100, 1)[0] == 2


def test_quality_empty(none):
    assert qc.quality_cascade(none).count() == 0


def test_symbols_are_rejected():
    good = " ".join(f"word{i}x" for i in range(60))
    assert not any(r.rejects(qc.Text(good)) for r in qc.RULES)
    assert qc.RULES[0].rejects(qc.Text(good.replace(" ", "### ")))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=12), st.lists(st.booleans(), min_size=60, max_size=60), st.sampled_from(ta.RULES))
def test_attribution_against_brute_force(lengths, inside, rule):
    ends = np.cumsum(lengths)
    total = int(ends[-1])
    starts, stops, k = [], [], 0
    while k < total:  # runs of True are sections, cut at random
        if inside[k]:
            j = k + 1
            while j < total and inside[j] and j % 4:
                j += 1
            starts.append(k)
            stops.append(j)
            k = j
        else:
            k += 1
    if not starts:
        return
    section, outside = ta.attribute(ends, (np.array(starts), np.array(stops)), rule)
    for (a, b), s, o in zip(zip(ends - lengths, ends), section, outside):
        over = [max(0, min(b, y) - max(a, x)) for x, y in zip(starts, stops)]
        if not any(over):
            expected = max([i for i, x in enumerate(starts) if x < b], default=0)
        elif rule == "majority":
            expected = over.index(max(over))
        else:
            expected = next(i for i, v in enumerate(over) if v)
        assert s == expected
        assert o == (a < starts[expected] or b > stops[expected])


def test_section_tokens(spark, odd, none, encoder):
    for docs in (odd, table(spark, "documents")):
        got = defaultdict(list)
        for r in ta.section_tokens(docs).collect():
            got[r.doc_id].append(r)
        tokens = defaultdict(int)
        lines = Counter()
        for r in docs.collect():
            tokens[r.doc_id] += len(encoder.encode(r.text or ""))
            lines[r.doc_id] += max(1, sum(bool(x) for x in (r.text or "").split("\n")))
        assert {k: sum(r.n_tokens for r in v) for k, v in got.items()} == tokens
        assert {k: len(v) for k, v in got.items()} == lines
    assert ta.section_tokens(none).count() == 0
    with pytest.raises(ValueError):
        ta.section_tokens(odd, rule="x")


def test_section_spans_are_the_lines(encoder):
    text = "\nüber alles\n\n😀 end\n"
    starts, stops = ta.line_sections(text)
    assert [text[a:b] for a, b in zip(starts, stops)] == ["über alles", "😀 end"]
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    a, b = ta.byte_spans(raw, (starts, stops))
    assert [bytes(raw[x:y]).decode() for x, y in zip(a, b)] == ["über alles", "😀 end"]
    assert encoder.lengths[encoder.encode(text)].sum() == len(raw)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3_000), st.integers(0, 1 << 60))
def test_permutation(n, key):
    slots = ts.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert ts.permute(slots, n, key, inverse=True).tolist() == list(range(n))


def test_shards_round_trip(spark, odd, encoder):
    for docs, length, records in ((odd, 64, 100), (table(spark, "documents"), 2_048, 16)):
        index = ts.write_shards(docs, length=length, shard_records=records)
        rows = index.orderBy("slot").collect()
        n = len(rows)
        assert [r.slot for r in rows] == list(range(n))
        assert all(r.shard == r.slot // records and r.position == r.slot % records * length * 2 for r in rows)
        got = {r.slot: np.array(r.tokens) for r in ts.read_slots(index, 0, n, length, records).collect()}
        assert all(hashlib.sha256(got[r.slot].astype("<u2").tobytes()).hexdigest() == r.sha256 for r in rows)
        # back in the order of the packed stream, the tokens of a document stand together
        numbers = {(r.part, r.seq): r for r in rows}
        texts = Counter()
        stream, open_id = [], None
        for k in sorted(numbers):
            r = numbers[k]
            for d in r.docs:
                stream += got[r.slot][d.start : d.start + d.n].tolist()
                open_id = d.id
                if stream[-1] == END_OF_TEXT:
                    texts[open_id, encoder.decode(np.array(stream[:-1]))] += 1
                    stream = []
        assert texts == Counter((r.doc_id, r.text or "") for r in docs.collect())
        part = ts.read_slots(index, 3, 9, length, records).orderBy("slot").collect()
        assert [r.slot for r in part] == list(range(3, min(9, n)))


def test_shards_of_nothing(none):
    assert ts.write_shards(none).count() == 0


def test_slots_are_the_permutation_of_the_stream(spark):
    rows = ts.write_shards(table(spark, "documents"), length=128, shard_records=64).collect()
    ordered = sorted(rows, key=lambda r: (r.part, r.seq))
    assert [r.slot for r in ordered] == ts.permute(np.arange(len(rows)), len(rows)).tolist()


def test_machine_learns_a_pair():
    """Two words are harmless alone and toxic together: no additive weight can say so."""
    r = random.Random(1)
    texts, y = [], []
    for _ in range(1_500):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join(["filler", *["insult"] * a, *["group"] * b]))
        y.append(int(a and b))
    y = np.array(y)
    m = fm.fit([np.array(fm.text_terms(t)) for t in texts], y, min_z=1.0)
    score = lambda t: m.score([m.index[k] for k in fm.text_terms(t) if k in m.index])
    assert score("insult group") > 0.9 and max(score("insult"), score("group"), score("filler")) < 0.1
    assert np.abs(m.v).max() > 0.1


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = fm.toxicity(docs, labels).select("doc_id", fm.held_out(F.col("doc_id")).alias("h"), "predicted").join(labels, "doc_id").where("h").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / sum(r.toxic for r in got) > 0.85 and hits / sum(r.predicted for r in got) > 0.93


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (5, 0), (7, 1)], "doc_id long, toxic int")
    got = fm.toxicity(odd, labels)
    assert got.count() == odd.count() and set(got.columns) == set(odd.columns)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.collect())
    assert {r.score < 0.01 for r in fm.toxicity(odd, labels.limit(0)).collect()} == {True}
    assert fm.toxicity(none, labels).count() == 0


def test_line_templates(spark):
    texts = [
        "a first line that stays here\nuser 17 logged in from host 4 today\nabc", "user 99 logged in from host 12 today\nsomething else that stays here too",
        "user 5 logged in from host 8 yesterday\nabc", "no such line is in here", None, "", "abc\nabc",
    ]
    got = lt.drop_recurring_lines(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc string")).orderBy("doc_id").collect()
    assert [r.text for r in got] == [texts[0], "something else that stays here too", "abc", texts[3], None, "", "abc\nabc"]
    assert [r.n_dropped for r in got] == [0, 1, 1, 0, 0, 0, 0] and [r.n_lines for r in got] == [3, 2, 2, 1, 0, 1, 2]


def test_clusters_against_a_full_scan(spark):
    """The index over positions finds the template that comparing with all of them finds."""
    r = random.Random(4)
    rows = []
    for leaf in range(3):
        for v in range(250):
            size = 6 + 4 * leaf
            rows.append((leaf, 0, v, " ".join(["<*>" if r.random() < 0.1 else r.choice("abcde"[: 2 + leaf]) for _ in range(size)]), r.randint(1, 5)))
    schema = "leaf long, block long, v long, words string, n long"
    got = {(x.leaf, x.v): x.t for x in lt.generalise(spark.createDataFrame(rows, schema)).collect()}
    expected = {}
    for leaf in range(3):
        templates = []
        for _, _, v, words, n in sorted((x for x in rows if x[0] == leaf), key=lambda x: (-x[4], x[3], x[2])):
            w = words.split(" ")
            scores = [sum(a == b for a, b in zip(t, w)) for _, t in templates]
            if scores and 100 * max(scores) >= lt.SIMILARITY * len(w):
                k = scores.index(max(scores))
                templates[k] = templates[k][0], [a if a == b else "<*>" for a, b in zip(templates[k][1], w)]
                expected[leaf, v] = templates[k][0]
            else:
                templates.append((v, w))
                expected[leaf, v] = v
    assert got == expected and len(set(got.values())) < len(got)


def greedy(rows):
    """Template name of every ``v, words, n``, comparing each line with all templates so far; and the templates' words."""
    templates, names = [], {}
    for v, words, _ in sorted(rows, key=lambda x: (-x[2], x[1], x[0])):
        w = words.split(" ")
        scores = [sum(a == b for a, b in zip(t, w)) for _, t in templates]
        if scores and 100 * max(scores) >= lt.SIMILARITY * len(w):
            k = scores.index(max(scores))
            templates[k] = templates[k][0], [a if a == b else "<*>" for a, b in zip(templates[k][1], w)]
            names[v] = templates[k][0]
        else:
            templates.append((v, w))
            names[v] = v
    return names, dict(templates)


def joined(templates):
    """Smallest name that links of similar templates reach, by comparing all pairs."""
    root = {v: v for v in templates}
    for a in sorted(templates):
        for b in sorted(templates):
            same = sum(x == y for x, y in zip(templates[a], templates[b]))
            if root[a] != root[b] and 100 * same >= lt.SIMILARITY * len(templates[a]):
                low, high = sorted((root[a], root[b]))
                root = {v: low if r == high else r for v, r in root.items()}
    return root


@pytest.mark.parametrize("block", [256, 16])
def test_clusters_above_the_block_size(spark, monkeypatch, block):
    """A leaf of several blocks, one of a single block and one of a single line, against comparing everything."""
    monkeypatch.setattr(lt, "BLOCK", block)
    r = random.Random(7)
    rows = [(9, 10_000, "one line of its own here", 2)]
    for leaf, count, size, letters in ((0, 2 * block + 90, 9, "abcdefghijkl"), (1, block // 2, 12, "abcd"), (2, 2 * block, 5, "abcdefghijklmnopqrstuvwxyz")):
        seen = set()
        while len(seen) < count:
            tail = [r.choice(letters) + (r.choice(letters) if leaf == 2 else "") for _ in range(size - 4)]
            seen.add(" ".join(["w", "x", "<*>", "z", *("<*>" if r.random() < 0.1 else t for t in tail)]))
        rows += [(leaf, 1_000 * leaf + v, words, r.randint(1, 5)) for v, words in enumerate(sorted(seen)[:999])]
    variants = spark.createDataFrame(rows, "leaf long, v long, words string, n long")
    sizes = Counter(x[0] for x in rows)
    of = {x.v: x.h for x in variants.select("v", F.xxhash64("v").alias("h")).collect()}
    expected, first, crowded = {}, {}, 0
    for leaf, count in sizes.items():
        blocks = defaultdict(list)
        for x in rows:
            if x[0] == leaf:
                blocks[of[x[1]] % -(-count // block)].append(x[1:])
        names, templates = {}, {}
        for part in blocks.values():
            some, words = greedy(part)
            names |= some
            templates |= words
        crowded += len(templates) > block
        root = joined(templates)
        first |= names
        expected |= {v: root[t] for v, t in names.items()}
    got = {x.v: x.top for x in lt.clusters(variants).collect()}
    assert got == expected and len(set(expected.values())) < len(set(first.values()))
    assert crowded or block == 256


def test_a_hot_leaf_makes_bounded_groups(spark, monkeypatch):
    """20,000 unlike lines of one leaf: no task gets more than two blocks, and the similar ones are found."""
    rows = [(5, v, f"time level host user {' '.join(f'k{v}w{j}' for j in range(8))}") for v in range(20_000)]
    rows += [(5, 30_000 + v, f"{rows[v][2].rsplit(' ', 2)[0]} other end") for v in range(50)]
    groups, compare = [], lt.compare_blocks

    def seen(df):
        groups.append(df.groupBy("leaf", "key", "p", "q").count().agg(F.max("count"), F.sum("count")).first())
        return compare(df)

    monkeypatch.setattr(lt, "compare_blocks", seen)
    pairs = {tuple(sorted(x)) for x in lt.similar(spark.createDataFrame(rows, "leaf long, v long, words string")).collect()}
    assert pairs == {(v, 30_000 + v) for v in range(50)}
    assert groups[0][0] <= 2 * lt.BLOCK and groups[0][1] < 2_000


def test_every_document_counts_once(spark):
    """Two variants of a template in one document are one document; documents are counted exactly where bounds leave it open."""
    line = "user {} left the big room {}"
    texts = ["{}\n{}".format(line.format(1, "now"), line.format(2, "later")), line.format(3, "today"), "job a b c done\njob a b c ended", "job a b c failed", "job a b c lost"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_dropped for r in lt.drop_recurring_lines(docs, min_docs=3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1}
    got = {r.doc_id: r.n_dropped for r in lt.drop_recurring_lines(docs, min_docs=2).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 1}
    assert all(r.n_dropped == 0 for r in lt.drop_recurring_lines(docs, min_docs=4).collect())


def test_short_lines(spark):
    """With a limit of one word, lines of one to three words recur when they are equal but for fields; blank lines stay."""
    texts = ["abc\n\nall rights reserved\npage 3\na b", "abc\n\nall rights gone\nPage 4\na  b", " all rights  reserved\n \npage 17\nb", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in lt.drop_recurring_lines(docs, min_words=1).orderBy("doc_id").collect()]
    assert got == [texts[0], "\nall rights gone\nPage 4", " \nb", None, ""]
    kept = [r.text for r in lt.drop_recurring_lines(docs).orderBy("doc_id").collect()]
    assert kept == texts


def test_short_lines_of_the_table(spark):
    """The registered query: a line of any length is in the first document with its words only."""
    docs = table(spark, "documents")
    first = {}
    key = lambda x: tuple("<*>" if re.search(r"[0-9]", w) else w for w in WORDS.findall(x))
    for r in docs.orderBy("doc_id").collect():
        for x in (r.text or "").split("\n"):
            first.setdefault(key(x), r.doc_id)
    got = lt.drop_recurring_lines(docs, min_words=1).collect()
    assert all(not key(x) or first[key(x)] == r.doc_id for r in got for x in (r.text or "").split("\n"))


def test_line_templates_exact_lines(spark):
    """Equal lines of different documents always go, whatever else is in their leaf."""
    docs = table(spark, "documents")
    first = {}
    key = lambda x: tuple("<*>" if re.search(r"[0-9]", w) else w for w in WORDS.findall(x))
    for r in docs.orderBy("doc_id").collect():
        for x in (r.text or "").split("\n"):
            first.setdefault(key(x), r.doc_id)
    for r in lt.drop_recurring_lines(docs).collect():
        assert all(len(key(x)) < lt.MIN_WORDS or first[key(x)] == r.doc_id for x in r.text.split("\n"))


def test_line_templates_odd_rows(odd, none):
    got = lt.drop_recurring_lines(odd).collect()
    assert len(got) == odd.count()
    one = [r.text for r in got if r.doc_id == 1]
    assert one == [one[0]] * 2 and one[0]
    assert [r.text for r in got if r.doc_id == 2] == [""]
    assert lt.drop_recurring_lines(none).count() == 0


def test_line_templates_of_a_row_without_id(spark):
    """Two variants of one template, one in a row without id: it stays in the document with one."""
    docs = spark.createDataFrame([(None, "user 17 left the room today"), (5, "user 21 left the room soon")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in lt.drop_recurring_lines(docs).collect()}
    assert got == {None: ("", 1), 5: ("user 21 left the room soon", 0)}


def test_tokens_beyond_the_width_are_refused(spark, tmp_path):
    """A vocabulary whose ids begin above what two bytes hold."""
    with open(f"{FOLDER}/{VOCABULARY}") as f:
        pairs = [line.split() for line in f]
    (tmp_path / "large.tiktoken").write_text("".join(f"{token} {int(rank) + 70_000}\n" for token, rank in pairs))
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        ts.write_shards(docs, vocabulary=str(tmp_path / "large.tiktoken"))


def test_toxicity_with_ids_of_text(spark):
    """The order of the fit follows the ids, or their hashes where they are no numbers."""
    docs = spark.createDataFrame([(f"k{i}", "you are an awful idiot" if i % 2 else "a fine day at the lake") for i in range(80)], "doc_id string, text string")
    labels = docs.select("doc_id", F.lit(0).alias("quality"), F.col("text").contains("awful").cast("int").alias("toxic"))
    assert {(r.text, r.predicted) for r in fm.toxicity(docs, labels).collect()} == {("you are an awful idiot", 1), ("a fine day at the lake", 0)}
