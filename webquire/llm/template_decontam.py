"""Benchmark decontamination by template windows, with DataFrame functions only.

Numbers, units after numbers, and capitalised words become typed placeholders, one token each. Windows of ``WINDOW``
template tokens are hashed and joined between documents and benchmark items, so a question with other numbers or names
still meets its template. Matches at one placement of an item (document position minus item position) are then checked:
windows with unchanged slot values count as they are, the others if the changed values map one to one.

A second stream of windows has the names in lower case instead of placeholders, so that copies in another letter case
are found; its placements count where the first stream finds none,
then windows of neighbouring placements added up, then the word-by-word alignment of short items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquire.llm.common import small
from webquire.session import cut

WINDOW = 8
# A window of an item must keep so many literal words to count as a template.
MIN_LITERALS = 3
# Shorter items are no evidence.
MIN_WORDS = 5
# Placement rule: this share of the item's windows, or this many of them.
MIN_SHARE = 0.5
MIN_WINDOWS = 6
# Matched windows of placements this near are added up: words were inserted or left out.
SHIFT = 2
# Items of SHORT[0] to SHORT[1] words are also aligned word by word where they share SEED tokens in a row with a
# document; this share of their words must be there. With fewer words a changed word makes another item.
SHORT = (8, 29)
SEED = 4
MIN_ALIGNED = 0.8
ALIGNED = 2  # the stream of these rows
# Words on each side of a match that are looked at.
AROUND = SHORT[1] + SHIFT

# Typed placeholders: private-use characters, one per type.
NUMBER, NAME, UNIT = "", "", ""
# Marks taken off the edges of words, as a character class.
MARKS = r"""!"'()*,\-./:;?\[\]_`{}¡¿«»‘’“”…–—"""
# Units recognised directly after a number.
UNITS = (
    "km", "m", "cm", "mm", "mi", "ft", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "s", "min", "h", "miles", "meters", "metres",
    "feet", "inches", "pounds", "grams", "liters", "litres", "seconds", "minutes", "hours", "hour", "days", "day", "weeks", "week",
    "months", "month", "years", "year", "dollars", "euros", "cents", "percent", "degrees",
)


def _bare(text: Column) -> Column:
    """``text`` with placeholders for numbers and units, and without marks at the edges of words. Every word stays one word."""
    t = F.regexp_replace(text, r"[$€£]?[0-9](?:[0-9.,:/]*[0-9])?%?", NUMBER)
    t = F.regexp_replace(t, rf"(?<={NUMBER}[ -]?)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}])", UNIT)
    # marks after a word's last letter, or before its first one; a word of marks alone stays
    rest = rf"[^{MARKS}\x20\x09-\x0D]"
    return F.regexp_replace(t, rf"[{MARKS}](?:(?<={rest}.)[{MARKS}]*+(?=[\x20\x09-\x0D]|\z)|(?<![^\x20\x09-\x0D].)[{MARKS}]*+(?={rest}))", "")


def _named(bare: Column) -> Column:
    return F.lower(F.regexp_replace(bare, r"(?<![\p{L}\p{N}])\p{Lu}[\p{L}\p{M}]*+", NAME))


def template(text: Column) -> Column:
    """``text`` with placeholders, lower case, and without marks at the edges of words. Every word stays one word."""
    return _named(_bare(text))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _tokens(rows: DataFrame) -> DataFrame:
    """``rows`` with the token arrays of the streams: ``t0`` with names as placeholders, ``t1`` with names in lower case, which letter case does not change."""
    rows = rows.withColumn("bare", _bare(F.col("text")))
    return rows.select("*", words(_named(F.col("bare"))).alias("t0"), words(F.lower("bare")).alias("t1")).drop("bare")


def _literal(rows: DataFrame) -> DataFrame:
    return rows.withColumn("t0", words(F.lower("text")))


def _hashed(rows: DataFrame, stream: int) -> DataFrame:
    """``rows`` with ``h<stream>``: at each token the hash of it and the three that follow.

    Hashes double their reach twice, so each window costs a few operations on longs. Past the end they cover less.
    """
    double = lambda c, by: F.zip_with(c, F.slice(c, by + 1, F.size(c)), lambda x, y: F.xxhash64(x, y))
    rows = rows.withColumn("h1", F.transform(f"t{stream}", lambda t: F.xxhash64(t)))
    return rows.withColumn("h2", double(F.col("h1"), 1)).drop("h1").withColumn(f"h{stream}", double(F.col("h2"), 2)).drop("h2")


def _windows(n: int, stream: int) -> Column:
    """Hashes of the windows of ``n`` tokens (5 to 8): two of four tokens, overlapping below 8."""
    h = f"h{stream}"
    whole = F.zip_with(h, F.slice(h, n - 3, F.size(h)), lambda x, y: F.xxhash64(F.lit(n + 16 * stream), x, y))
    return F.slice(whole, 1, F.greatest(F.size(h) - n + 1, F.lit(0)))


def _value(word: Column) -> Column:
    """What two slot values are compared by."""
    return F.lower(F.regexp_replace(word, r"[^\p{L}\p{N}%]", ""))


def _slot(token: Column) -> Column:
    return token.rlike(f"[{NUMBER}{NAME}{UNIT}]")


def _item_windows(items: DataFrame, stream: int, lengths: list[int], exact: bool) -> DataFrame:
    """``item_id, stream, seed, n, hash, k, n_windows, slots, values``: an item's distinct windows; of equal ones the first.

    ``seed`` is the hash of a window's first ``SEED`` tokens, by which documents look it up.
    """
    size = F.size(f"t{stream}")
    n = F.least(size, F.lit(WINDOW))
    rows = _hashed(items, stream).where(size >= MIN_WORDS).withColumn("raw", words(F.col("text")))
    own = F.coalesce(*(F.when(n == k, _windows(k, stream)) for k in lengths))
    rows = rows.withColumn("n", n).select("item_id", "raw", F.col(f"t{stream}").alias("tok"), F.col(f"h{stream}").alias("h"), "n", F.posexplode(own).alias("k", "hash"))
    rows = rows.withColumn("part", F.slice("tok", F.col("k") + 1, F.col("n")))
    places = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: _slot(F.element_at("part", i + 1)))
    rows = rows.withColumn("slots", places)
    if not exact:
        rows = rows.where(F.col("n") - F.size("slots") >= F.least(F.lit(MIN_LITERALS), F.col("n")))
    rows = rows.withColumn("seed", F.element_at("h", F.col("k") + 1))
    rows = rows.groupBy("item_id", "hash").agg(F.min(F.struct("k", "slots", "raw", "n", "seed")).alias("f"))
    values = F.transform("f.slots", lambda p: _value(F.element_at(F.col("f.raw"), F.col("f.k") + p + 1)))
    counts = rows.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n_windows"))
    rows = rows.join(counts, rows["item_id"].eqNullSafe(counts["i"]))
    return rows.select("item_id", F.lit(stream).alias("stream"), "f.seed", "f.n", "hash", "f.k", "n_windows", "f.slots", values.alias("values"))


def _short(items: DataFrame) -> DataFrame:
    """``item_id, text_hash, short``: the tokens and values of the items that are aligned word by word."""
    values = F.transform(words(F.col("text")), _value)
    return items.where(F.size("t1").between(*SHORT)).select("item_id", F.xxhash64("text").alias("text_hash"), F.struct("t0", "t1", values.alias("values")).alias("short"))


def _seeds(shorts: DataFrame) -> DataFrame:
    """``item_id, text_hash, stream, seed, k``: windows of ``SEED`` tokens of the short items."""
    rows = _hashed(_hashed(shorts.select("item_id", "text_hash", "short.t0", "short.t1"), 0), 1)
    parts = []
    for stream in (0, 1):
        part = rows.select("item_id", "text_hash", f"t{stream}", F.posexplode(F.slice(f"h{stream}", 1, F.size(f"h{stream}") - SEED + 1)).alias("k", "seed"))
        literals = F.size(F.filter(F.slice(f"t{stream}", F.col("k") + 1, SEED), lambda t: ~_slot(t)))
        parts.append(part.where(literals >= MIN_LITERALS).select("item_id", "text_hash", F.lit(ALIGNED).alias("stream"), "seed", "k"))
    return parts[0].unionByName(parts[1]).distinct()


def _aligned(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fit``: for a short item's row ``n_matched, n_windows, n_changed`` in words, compared within ``SHIFT`` words of its place."""
    at = F.col("here") - F.col("k")

    def word(i: Column) -> Column:
        here = lambda arr, by: F.get(f"near_{arr}", at + i + by)
        item, value = F.get("short.t1", i), F.get("short.values", i)
        near = sorted(range(-SHIFT, SHIFT + 1), key=abs)
        pair = lambda v: F.struct(value.alias("item"), v.alias("doc"))
        same = [F.when((here("t1", by) == item) & (~_slot(item) | (_value(here("raw", by)) == value)), pair(value)) for by in near]
        other = [F.when((here("t0", by) == F.get("short.t0", i)) & _slot(F.get("short.t0", i)), pair(_value(here("raw", by)))) for by in near]
        return F.coalesce(*same, *other)

    each = F.transform(F.sequence(F.lit(0), F.size("short.t1") - 1), word)
    rows = rows.withColumn("each", F.when(F.col("stream") == ALIGNED, F.filter(each, lambda p: p.isNotNull())))
    rows = rows.withColumn("same", F.filter("each", lambda p: p["item"] == p["doc"])).withColumn("some", F.array_distinct("each"))
    n, changed = _judged("each", "same", "some")
    return rows.withColumn("fit", F.when(F.col("stream") == ALIGNED, F.struct(n.alias("n_matched"), F.size("short.t1").cast("long").alias("n_windows"), changed.alias("n_changed")))).drop("each", "same", "some")


def _matches(docs: DataFrame, windows: DataFrame, tokens: Callable[[DataFrame], DataFrame], streams: list[int], shorts: DataFrame | None = None) -> DataFrame:
    """``doc, which, item_id, stream, at, k, n_windows, pairs, fit`` for every window of a document that is one of an item.

    A document looks up one hash per token, that of ``SEED`` tokens; the second stream adds only those that differ from
    the first. Windows are compared where a seed is found. Rows of short items have ``fit`` only. It is judged after
    grouping: a filter here would move into the join and be evaluated on whole documents.
    """
    n = windows.count()
    whole = tokens(docs).withColumn("raw", words(F.col("text")))
    for stream in streams:
        whole = _hashed(whole, stream)
    first = f"h{streams[0]}"
    others = [F.zip_with(f"h{s}", first, lambda own, base: F.when(own != base, own)) for s in streams[1:]]
    texts = ["raw", *(f"t{s}" for s in streams if shorts is not None), *(f"h{s}" for s in streams)]
    # two steps: exploding the expression itself would have it run again for the optimizer's size and null checks
    rows = whole.select("doc", "which", *texts, F.explode(F.array(F.concat(first, *others))).alias("w"))
    rows = rows.select("doc", "which", *texts, F.posexplode("w").alias("at", "seed"))
    rows = rows.withColumn("pos", F.pmod("at", F.size(first))).drop("at")
    if small(windows, n) is not windows:  # the words ride along, as nothing is shuffled
        back = rows.join(small(windows, n), "seed")
    else:
        narrow = rows.select("doc", "which", "pos", "seed").join(windows, "seed")
        apart = whole.select(F.col("doc").alias("d"), F.col("which").alias("h"), *texts).dropDuplicates(["d", "h"])
        back = narrow.join(apart, narrow["doc"].eqNullSafe(apart["d"]) & narrow["which"].eqNullSafe(apart["h"]))

    def window(stream: int) -> Column:
        h, pos = F.col(f"h{stream}"), F.col("pos")
        inside = pos + F.col("n") <= F.size(h)
        return inside & (F.col("hash") == F.xxhash64(F.col("n") + 16 * stream, F.get(h, pos), F.get(h, pos + F.col("n") - SEED)))

    same = F.coalesce(*(F.when(F.col("stream") == s, window(s)) for s in streams), F.col("stream") == ALIGNED)
    back = back.where(same)
    texts = [c for c in texts if not c.startswith("h")]
    # a match keeps the words around it only: a task holds all matches of a document at once
    start = F.greatest(F.col("pos") - AROUND, F.lit(0))
    around = [F.slice(c, start + 1, 2 * AROUND + 1).alias(f"near_{c}") for c in texts]
    back = back.select("doc", "which", "pos", (F.col("pos") - start).alias("here"), *windows.columns, *around)
    if shorts is not None:  # the words of each short item once, not with each of its seeds
        own = small(shorts.select(F.col("item_id").alias("of"), F.col("text_hash").alias("of_text"), "short"), shorts.count())
        back = back.join(own, back["item_id"].eqNullSafe(own["of"]) & (back["text_hash"] == own["of_text"]), "left")
    pair = F.zip_with("slots", "values", lambda p, v: F.struct(v.alias("item"), _value(F.element_at("near_raw", F.col("here") + p + 1)).alias("doc")))
    fit = "struct<n_matched:bigint,n_windows:bigint,n_changed:int>"
    back = _aligned(back) if shorts is not None else back.withColumn("fit", F.lit(None).cast(fit))
    k = F.when(F.col("stream") != ALIGNED, F.col("k")).alias("k")
    return back.select("doc", "which", "item_id", "stream", (F.col("pos") - F.col("k")).alias("at"), k, "n_windows", F.when(F.col("stream") != ALIGNED, pair).alias("pairs"), "fit")


def _judged(ks: str, same: str, pairs: str) -> tuple[Column, Column]:
    """``n_matched, n_changed``: windows with unchanged slots count on their own, the others if the changed slots map one to one."""
    changed = F.filter(pairs, lambda p: p["item"] != p["doc"])
    side = lambda name: F.size(F.array_distinct(F.transform(changed, lambda p: p[name])))
    one_to_one = (side("item") == F.size(changed)) & (side("doc") == F.size(changed))
    return F.when(one_to_one, F.size(ks)).otherwise(F.size(same)).cast("long"), F.when(one_to_one, F.size(changed)).otherwise(0)


def _enough(n_matched: Column) -> Column:
    return (n_matched >= MIN_SHARE * F.col("n_windows")) | (n_matched >= MIN_WINDOWS)


def _decided(matches: DataFrame) -> DataFrame:
    """The best placement of each document and item that meets the placement rule."""
    same = F.collect_set(F.when(~F.exists("pairs", lambda p: p["item"] != p["doc"]), F.col("k"))).alias("same")
    bound = matches.groupBy("doc", "which", "item_id", "stream", "at", "n_windows").agg(F.collect_set("k").alias("ks"), same, F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.max("fit").alias("fit"))
    near = Window.partitionBy("doc", "which", "item_id", "stream").orderBy("at").rangeBetween(-SHIFT, SHIFT)
    for c in ("ks", "same", "pairs"):
        bound = bound.withColumn(f"near_{c}", F.array_distinct(F.flatten(F.collect_list(c).over(near))))
    (alone, changed), (together, changed_near) = _judged("ks", "same", "pairs"), _judged("near_ks", "near_same", "near_pairs")
    row = lambda n, c, how: F.struct(n.alias("n_matched"), F.col("n_windows"), F.col("at"), c.alias("n_changed"), how.alias("how"))
    fit = F.struct("fit.n_matched", "fit.n_windows", F.col("at"), "fit.n_changed", F.lit(3).alias("how"))
    way = F.when(F.col("stream") == ALIGNED, F.when(F.col("fit.n_matched") >= MIN_ALIGNED * F.col("fit.n_windows"), fit)).when(_enough(alone), row(alone, changed, F.col("stream"))).when(_enough(together), row(together, changed_near, F.lit(2)))
    good = bound.select("doc", "which", "item_id", way.alias("way")).where("way is not null").select("doc", "which", "item_id", "way.*")
    return good.groupBy("doc", "which", "item_id").agg(_best()).select("doc", "which", "item_id", "b.*")


def _best() -> Column:
    """The first way of finding an item counts, then the placement."""
    return F.max_by(F.struct("n_matched", "n_windows", "at", "n_changed", "how"), F.struct(-F.col("how"), "n_matched", -F.col("n_changed"), -F.col("at"))).alias("b")


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame | None:
    """``doc, which, item_id, n_matched, n_windows, at, n_changed`` by id and text (``which``, a hash); None without items."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("which"), F.col(text_col).alias("text")).where("text is not null")
    size = F.least(F.size(words(F.col("text"))), F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(size.alias("n")).where(F.col("n") >= MIN_WORDS).distinct().collect())  # WINDOW values at most
    if not lengths:
        return None
    items = items.where(F.size(words(F.col("text"))) >= MIN_WORDS)
    typed = cut(_item_windows(_tokens(items), 0, lengths, exact=False), "decontam-windows")
    folded = _item_windows(_tokens(items), 1, lengths, exact=False)
    shorts = cut(_short(_tokens(items)), "decontam-short")
    windows = cut(typed.unionByName(folded).unionByName(_seeds(shorts), allowMissingColumns=True), "decontam-windows")
    rest = items.join(typed.select(F.col("item_id").alias("i")).distinct(), F.col("item_id").eqNullSafe(F.col("i")), "left_anti")
    exact = cut(_item_windows(_literal(rest), 0, lengths, exact=True), "decontam-literal")
    matches = [_matches(texts, windows, _tokens, [0, 1], shorts)] + ([_matches(texts, exact, _literal, [0])] if exact.take(1) else [])
    return _decided(matches[0] if len(matches) == 1 else matches[0].unionByName(matches[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id_col, item_id, n_matched, n_windows, at, n_changed``: which documents hold which items.

    ``at`` is the word at which the item would start, ``n_changed`` counts slots with another value than the item's (0:
    a literal copy). Items of fewer than ``MIN_WORDS`` words are no evidence and never match; those up to ``WINDOW``
    words match as a whole. Items all of whose windows are mostly slots are compared literally. Null and empty texts hold
    nothing. Rows that share an id (null included) are judged each by its text, and the id has the best of their placements;
    repeated items are found each. Other columns are left out. Empty tables give no rows.
    """
    found = _found(docs, benchmark, id_col, text_col, item_col, item_text_col)
    if found is None:
        kinds = (("n_matched", "long"), ("n_windows", "long"), ("at", "int"), ("n_changed", "int"))
        return docs.limit(0).select(F.col(id_col), F.lit(None).cast(benchmark.schema[item_col].dataType).alias("item_id"), *(F.lit(0).cast(t).alias(c) for c, t in kinds))
    found = found.groupBy("doc", "item_id").agg(_best()).select("doc", "item_id", "b.*")
    return found.select(F.col("doc").alias(id_col), "item_id", "n_matched", "n_windows", "at", "n_changed")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds an item. Rows that share an id (null included) are judged each by its text; only those without a text go with a hit of their id."""
    found = _found(docs, benchmark, id_col, text_col, "item_id", "text")
    if found is None:
        return docs
    own = found.select(F.col("doc").alias("__hit"), F.col("which").alias("__which"))
    without = own.select("__hit", F.xxhash64(F.lit(None).cast("string")).alias("__which"))
    hits = cut(own.union(without).distinct(), "decontam-hits")
    return docs.join(small(hits, hits.count()), docs[id_col].eqNullSafe(hits["__hit"]) & (F.xxhash64(docs[text_col]) == hits["__which"]), "left_anti")
