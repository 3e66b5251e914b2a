"""Near-duplicates, decontamination, mixing, archives, extraction, and the pipeline."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SF, table
from webquire.llm import covering_simhash as cs
from webquire.llm import dom_boosting as db
from webquire.llm import dom_tree as dt
from webquire.llm import mixing as mx
from webquire.llm import template_decontam as td
from webquire.llm import warc_chunks as wc
from webquire.llm.queries import LLM_ORACLES, LLM_QUERIES
from webquire.llm.sample_pages import labelled_pages


def brute_components(values, radius):
    """Smallest index reachable from each value."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= radius:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover_every_set_of_positions():
    masks = cs.covering_masks(4)
    assert len(masks) == 31 and all(20 < m.bit_count() < 44 for m in masks)
    r = random.Random(3)
    for _ in range(20_000):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 4)))
        assert any(flips & m == 0 for m in masks)


def test_fingerprint_by_definition():
    text = "Ä one TWO three four\tfive\x0bsix one two"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(len(words) - 3)]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert cs.fingerprint(text) == expected
    assert cs.fingerprint("") == cs.fingerprint(None) == cs.fingerprint(" \n") == 0
    assert cs.fingerprint("One two") == xxhash.xxh64_intdigest("one two", seed=42)


def test_jvm_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("größe one")).alias("h")).first().h
    assert got % (1 << 64) == xxhash.xxh64_intdigest("größe one", seed=42)


@pytest.mark.parametrize("block", [4, 2_048])
def test_links_against_all_pairs(spark, block):
    """Clusters, chains and a bucket far larger than a block."""
    r = random.Random(block)
    values = {r.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        v = r.getrandbits(64)
        for _ in range(60):
            v ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 5)))
            values.add(v)
    centre = r.getrandbits(64)
    values |= {centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = cs.link_forest(spark.createDataFrame([(v,) for v in signed], "fp long").repartition(3), 4, block)
    got = {e.node: e.root for e in cs.components(edges).collect()}
    expected, groups = brute_components(values, 4), defaultdict(set)
    for s, e in zip(signed, expected):
        groups[e].add(s)
    for members in groups.values():
        if len(members) == 1:
            assert not members & got.keys()
        else:
            assert {got[m] for m in members} == {min(members)}


def test_near_duplicates_against_all_pairs(spark, odd, none):
    for docs in (table(spark, "documents"), odd):
        rows = docs.select("doc_id", "text").collect()
        fps = [cs.fingerprint(r.text) for r in rows]
        root = brute_components(fps, 4)
        first = defaultdict(list)
        for r, k in zip(rows, root):
            first[k].append(r.doc_id)
        expected = Counter((r.doc_id, f"{f:016x}", min((i for i in first[k] if i is not None), default=None)) for r, f, k in zip(rows, fps, root))
        assert Counter(tuple(r) for r in cs.near_duplicates(docs).collect()) == expected
        kept = cs.keep_one(docs)
        assert kept.columns == docs.columns
        ids = Counter(r.doc_id for r in kept.collect())
        assert ids == Counter(min((i for i in g if i is not None), default=None) for g in first.values())
    assert cs.near_duplicates(none).count() == cs.keep_one(none).count() == 0
    lone = odd.withColumn("doc_id", F.lit(None).cast("long"))
    assert cs.keep_one(lone).count() == len(set(brute_components([cs.fingerprint(r.text) for r in odd.collect()], 4)))


ITEMS = [
    (1, "Anna has 12 apples and gives 5 apples to Tom before she walks 3 km to the old market with Tom"),
    (2, "the quick brown fox jumps over the lazy dog while nobody is watching from the window today"),
    (3, "only six words are in here"),
    (4, "too short"),
    (5, "A B C D E F G H I J"),
]


def hits(spark, texts, items=ITEMS):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r.n_changed for r in td.contaminated(docs, bench).collect()}


def test_decontamination_cases(spark):
    changed = "Mary has 40 apples and gives 7 apples to Bob before she walks 9 km to the old market with Bob"
    mixed = "Mary has 40 apples and gives 7 apples to Bob before she walks 9 km to the old market with Jim"
    texts = [
        f"Some text first. {ITEMS[0][1]}. And more.", f"x {changed} y", f"x {mixed} y", ITEMS[1][1].replace(" ", "\n"), f"{ITEMS[1][1]} {ITEMS[0][1]}",
        "so only six words are in here, right", "too short", "the quick brown fox sat", "", None, "a lazy dog jumps over the quick brown fox", "x A B C D E F G H I J y", "Q R S T U V W X Y Z",
    ]
    got = hits(spark, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (4, 1), (4, 2), (5, 3), (11, 5)}
    assert got[0, 1] == 0 and got[1, 1] == 5


def brute_matches(docs, items):
    """Literal copies: all of an item's words in a row."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    out = set()
    for d, t in docs:
        w = words(t)
        joined = " " + " ".join(w) + " "
        out |= {(d, i) for i, x in items if len(words(x)) >= td.MIN_WORDS and f" {' '.join(words(x))} " in joined}
    return out


def test_decontamination_finds_all_copies(spark):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in td.contaminated(docs, bench).collect()}
    assert got == brute_matches([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()]) and got
    kept = td.decontaminate(docs, bench)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {d for d, _ in got}


def test_decontamination_judges_changed_slots_alone(spark):
    """A repeated slot value of which one became another does not hide the copy."""
    item = "The boat left the harbour at dawn with 5 men and came back at dusk. The men had 5 fish to sell"
    texts = [item.replace(". The", ". This"), item.replace("5 fish", "6 fish"), item.replace("5 men", "7 men").replace("5 fish", "6 fish")]
    got = hits(spark, texts, [(1, item)])
    assert got[0, 1] == got[1, 1] == 1


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    item = "the letter from Anna says that the old mill by the river will be sold before the end of the summer"
    clean, hit = "a text about nothing at all that any benchmark could hold", f"first words {item} last words"
    docs = spark.createDataFrame([(None, hit), (None, clean), (1, clean), (1, hit), (2, clean), (None, hit.replace("Anna", "Berta")), (None, hit.replace("Anna", "Clara"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert Counter(r.doc_id for r in td.decontaminate(docs, bench).collect()) == Counter([None, 1, 2])
    assert {(r.doc_id, r.n_changed) for r in td.contaminated(docs, bench).collect()} == {(None, 0), (1, 0)}
    parts = " ".join(item.split()[:11]), "w " * 8 + " ".join(item.split()[8:19])  # two texts do not add up to a copy
    assert td.contaminated(spark.createDataFrame([(None, t) for t in parts], "doc_id long, text string"), bench).count() == 0


def test_keep_one_keeps_a_row_of_each_group(spark):
    one, other = "a text of its own about the harbour and the boats in it", "nothing here is like what stands in any of those rows"
    docs = spark.createDataFrame([(1, one, "b"), (1, other, "a"), (2, one, "a"), (1, one, "a"), (None, other, "z")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in cs.keep_one(docs).collect()) == [(1, one, "a"), (1, other, "a")]


def test_decontamination_in_another_letter_case(spark):
    item = "When Anna Berg and Tom Lind left Oslo for Rome, they had 40 euros and 3 bags with them in the train"
    assert set(hits(spark, [item.lower(), item.upper(), item.title(), f"so {item}"], [(1, item)])) == {(i, 1) for i in range(4)}


def test_decontamination_of_short_items_with_a_changed_word(spark):
    """A replaced or inserted word anywhere does not hide a short item, and part of one is no hit."""
    item = "the largest river of this country flows into which of the three named seas"
    w = item.split()
    for size in (8, 10, len(w)):
        part = w[:size]
        replaced = [" ".join(["x", *part[:i], "other", *part[i + 1 :], "y"]) for i in range(size)]
        inserted = [" ".join([*part[:i], "more", *part[i:]]) for i in range(1, size)]
        texts = [*replaced, *inserted, " ".join(part[: size // 2 + 1]), " ".join(reversed(part))]
        assert set(hits(spark, texts, [(1, " ".join(part))])) == {(i, 1) for i in range(len(texts) - 2)}


def test_decontamination_adds_up_neighbouring_placements(spark):
    w = [f"{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    text = " ".join(" ".join([*w[i : i + 12], "more"]) for i in range(0, 48, 12))
    assert set(hits(spark, [text], [(1, " ".join(w))])) == {(0, 1)}


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    one = sorted(td.contaminated(docs, bench).collect())
    monkeypatch.setattr(td, "small", lambda df, rows: df)
    assert sorted(td.contaminated(docs, bench).collect()) == one


def test_decontamination_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (1, "one two three four five six seven eight nine ten"), (None, "another text for the same id"), (3, None), (4, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in td.contaminated(odd, bench).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (8, 1), (8, None)}
    assert Counter(r.doc_id for r in td.decontaminate(odd, bench).collect()) == Counter({3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1})
    assert td.contaminated(none, bench).count() == 0 == td.contaminated(odd, bench.limit(0)).count()
    assert td.decontaminate(odd, bench.limit(0)).count() == odd.count()


def test_no_python_on_the_native_paths(spark):
    docs = table(spark, "documents")
    for df in (td.contaminated(docs, table(spark, "benchmark")), td.decontaminate(docs, table(spark, "benchmark")), mx.mix(docs), mx.draw(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().toString())


def test_targets_by_rounds(spark):
    """The level against handing the excess on round by round."""
    r = random.Random(5)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{k:02}": r.choice((0, 1, 5, 40, 1_000, 5_000)) for k in range(n)} | {None: 17}
        weight = {s: mx.WEIGHTS[k % 3] for k, s in enumerate([*sorted(s for s in sizes if s), None])}
        target, full, left = dict.fromkeys(sizes, 0.0), set(), float(sum(sizes.values()))
        while left > 1e-9 and len(full) < len(sizes):
            share = left / sum(w for s, w in weight.items() if s not in full)
            left = 0.0
            for s in sizes:
                if s not in full:
                    target[s] += share * weight[s]
                    if target[s] >= 3 * sizes[s]:
                        left += target[s] - 3 * sizes[s]
                        target[s] = 3.0 * sizes[s]
                        full.add(s)
        got = mx.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        assert {g.source: pytest.approx(g.target) for g in got} == target


def test_mix_properties(spark, odd, none):
    docs = table(spark, "documents")
    rows = mx.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    for group in by.values():
        assert abs(sum(r.taken for r in group) - group[0].target) <= max(r["size"] for r in group)
    assert sorted(mx.mix(docs.repartition(5)).collect()) == sorted(rows)
    drawn = Counter(r.doc_id for r in mx.draw(docs).collect())
    assert drawn == Counter({r.doc_id: r.copies for r in rows if r.copies})
    assert mx.mix(odd).count() == odd.count()
    assert mx.draw(odd).columns == odd.columns
    assert mx.mix(none).count() == mx.draw(none).count() == 0


def test_mix_buckets_are_even_at_every_quality(spark):
    """Rows of the lowest quality alone, of one class among others, and of every class."""
    q = F.when(F.col("source") == "junk", 0.05).when(F.col("source") == "both", F.when(F.col("id") % 3 == 0, 1.0).otherwise(0.05)).otherwise(0.05 + 0.95 * F.rand(5))
    rows = spark.range(240_000).select("id", F.element_at(F.array(*map(F.lit, ("junk", "both", "any"))), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.lit(1).alias("size"))
    narrow = rows.withColumn("quality", q).withColumn("key", -F.log(mx.uniform(F.col("id").cast("string"))) / F.col("quality"))
    keyed = mx.key_buckets(narrow, mx.source_targets(rows))
    per = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).orderBy("source", "bucket").collect()
    assert max(r.n for r in per) < 2 * mx.BUCKET_DOCS and len(per) > 50
    assert all(a.high <= b.low for a, b in zip(per, per[1:]) if a.source == b.source)


def test_mix_prefers_quality(spark):
    good, junk = "plain words of prose " * 5, "### $$$ %%% *** " * 6
    docs = spark.createDataFrame([(i, good if i % 2 else junk, "abc"[i % 3]) for i in range(3_000)], "doc_id long, text string, source string")
    rows = [r for r in mx.mix(docs).collect() if r.source == "c"]  # weight 1: a part of the first epoch
    share = lambda odd: np.mean([r.copies for r in rows if r.doc_id % 2 == odd])
    assert share(1) > 1.5 * share(0) > 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_statement(spark, name):
    from check import compare, connect

    spark_name = {name: LLM_QUERIES[name]}
    con = connect(SF)
    got = spark_name[name](spark, SF)
    result = con.execute(LLM_ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns) and compare
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("chunk, archive", [(7, 2_000), (1 << 20, 1 << 28)])
def test_archives_round_trip(spark, chunk, archive):
    same = "<p>" + "a repeated page " * 20
    rows = [
        (3, "http://a/1", same), (1, "http://a/2", same), (2, None, same), (4, "http://b/ü\r\nx", "héllo"), (5, "u", "héllo"), (6, "u", None), (7, "u", ""),
        (8, "u", "\r\n\r\nWARC/1.1\r\n" * 30), (None, "u", same), (9, "u", "z" * 5_000), (9, "u", "z" * 5_000),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload_bytes string").repartition(3)
    chunks = wc.warc_round_trip(pages, chunk, archive)
    parts = defaultdict(list)
    for r in chunks.collect():
        assert len(r.data) <= chunk
        parts[r.page_id].append(r)
    html = {k: (h or "").encode() for k, _, h in rows}
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in wc.record_table(chunks).collect())
    assert kinds == Counter([(1, "response", None), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (9, "response", None)])
    for k, found in parts.items():
        n = 2 if k == 9 else 1
        assert {(r.payload_bytes, r.payload_digest) for r in found} == {(len(html[k]), hashlib.sha256(html[k]).hexdigest())}
        if found[0].record_type == "response":
            data = sorted((r.chunk_no, bytes(r.data), r.sha256) for r in found)[::n]
            assert b"".join(d for _, d, _ in data) == html[k]
            assert data[-1][2] == hashlib.sha256(html[k]).hexdigest()
    assert wc.warc_round_trip(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    return db.trained()


def test_extraction_of_held_out_pages(model):
    right = wrong = missed = 0
    for page in map(dt.parse, labelled_pages(200, seed=99)):
        kept, truth = dt.decode(page, model.predict(dt.features(page))), dt.labels(page)
        for owner, run in page.runs:
            right += len(run) * (kept[owner] and truth[owner])
            wrong += len(run) * (kept[owner] and not truth[owner])
            missed += len(run) * (not kept[owner] and truth[owner])
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.95


def test_extraction_of_the_given_pages(spark, model):
    """Their articles are marked, so the text is known."""
    def truth(page):
        inside = [any(a.tag == "article" for a in up(page, owner)) for owner, _ in page.runs]
        return "\n".join(run for (_, run), x in zip(page.runs, inside) if x)

    def up(page, k):
        while k >= 0:
            yield page.nodes[k]
            k = page.nodes[k].parent

    pages = table(spark, "pages")
    got = {r.page_id: r for r in db.main_text(pages).collect()}
    same = [got[r.page_id].text == truth(dt.parse(r.html)) for r in pages.collect()]
    assert np.mean(same) > 0.97
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_decoding_is_the_best_consistent_labelling():
    r = random.Random(2)
    for _ in range(60):
        nodes = [dt.Node("#", -1, 0, 0)]
        for i in range(1, r.randint(2, 9)):
            p = r.randrange(i)
            nodes.append(dt.Node("div", p, 0, 0, own=r.choice((0, 3, 50))))
            nodes[p].children.append(i)
        page, prob = dt.Page(nodes, []), np.array([r.random() for _ in nodes])
        weight = [np.log1p(x.own) if x.own else 0.3 for x in nodes]

        def score(kept):
            return sum(w * np.log(p if k else 1 - p) for w, p, k in zip(weight, prob, kept))

        options = [[k >> i & 1 for i in range(len(nodes))] for k in range(1 << len(nodes))]
        options = [o for o in options if o[0] and all(o[x.parent] or not o[i] for i, x in enumerate(nodes) if i)]
        assert score(dt.decode(page, prob)) == pytest.approx(max(map(score, options)))


def test_parser_cases():
    text = lambda h: "|".join(r for _, r in dt.parse(h).runs)
    assert text("<p>a<p>b &amp; c<ul><li>x<li>y</ul>z") == "a|b & c|x|y|z"
    assert text('<p>one <b>two</b>\n three<br>four</p><script>if (a<b) "</p>";</script>five') == "one two three four|five"
    assert text("<p>cut <a href='x") == "cut" and text("a<!-- no --> b") == "a b" and text("a <") == "a" and text("x &am") == "x &am"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>d") == "a|b|c|d"
    assert text("<textarea>no</textarea><title>no</title>yes<style>p{}</style>") == "yes"
    assert text("") == "" and text("&nbsp; &copy;") == "©"
    # a quote delimits a value only behind "="
    assert text("<p title=it's>First</p><p>Second don't</p><p>Third</p>") == "First|Second don't|Third"
    assert text('<p class=x">a</p><p>b "c"</p>') == 'a|b "c"'
    assert text('<p title = "a>b" data-x=\'>\'>c</p>') == "c" and text('<p title="a>b') == "b"
    assert text("<ul><li><b>x<ul><li>y</b></ul><li>z</ul><p>u<div>v</x>w</div>") == "x|y|z|u|vw"


def test_parser_is_linear():
    for bad in ("<a " * 200_000, "<!--" * 200_000, "<script>" * 100_000, '<p title="' * 100_000, "<div>" * 20_000, "</x>" * 100_000):
        dt.parse(bad)
    start = time.time()
    dt.parse("<div>" * 20_000 + "</x>" * 20_000)
    dt.parse("<b>" * 20_000 + "<hr>" * 20_000 + "<li></li>" * 20_000)
    dt.parse("<li><ul>" + "<b>" * 20_000 + "<li></li>" * 20_000)
    assert time.time() - start < 10


def test_extraction_odd_rows(spark, model):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<nav><ul><li><a href=/a>no</a></li><li><a href=/b>not this</a></li></ul></nav>", "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    got = db.main_text(pages).collect()
    assert [r.n_chars for r in got] == [0] * 4 and {r.text for r in got} == {""}
    assert db.main_text(pages.limit(0)).count() == 0


def test_pipeline_against_its_stages_by_hand(spark):
    """The filters' decisions take effect one after the other; brute force on each stage's own input."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        seen.append((name, docs))
        docs = corpus_pipeline.cut(stage(spark, docs, sf), f"test-{name}")
        if name != "token_shards":
            assert docs.columns == columns
    inputs = dict(seen)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    toxic = ids(inputs["toxicity"]) - ids(inputs["near_duplicates"])
    marked = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert sum(marked.get(i, 0) for i in toxic) > 0.8 * sum(i in marked for i in toxic) > 0
    rows = inputs["near_duplicates"].collect()
    root = brute_components([cs.fingerprint(r.text) for r in rows], 4)
    first = {}
    for r, k in zip(rows, root):
        first[k] = min(first.get(k, r.doc_id), r.doc_id)
    assert ids(inputs["decontamination"]) == Counter(first.values())
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_matches([(r.doc_id, r.text) for r in inputs["decontamination"].collect()], bench)}
    gone = set(ids(inputs["decontamination"])) - set(ids(inputs["mixing"]))
    assert leaks and leaks <= gone
    part = [(i, " ".join(w[k : k + td.WINDOW])) for i, t in bench for w in [re.findall(r"[^\x20\x09-\x0D]+", t)] for k in range(0, len(w) - td.WINDOW)]
    rest = [(r.doc_id, r.text) for r in inputs["decontamination"].collect() if r.doc_id in gone - leaks]
    assert {d for d, _ in brute_matches(rest, part)} == gone - leaks  # altered copies
    copies = {r.doc_id: r.copies for r in mx.mix(inputs["mixing"]).collect() if r.copies}
    assert ids(inputs["token_shards"]) == Counter(copies)
    held = Counter()
    for r in docs.collect():
        for d in r.docs:
            held[d.id] += d.n
    assert set(held) == set(copies)
    assert sorted(r.slot for r in docs.collect()) == list(range(docs.count()))
