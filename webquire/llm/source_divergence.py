"""How far the word use of sources differs: exact divergences of all source pairs of a language, by cube partitioning.

Terms are counted per (language, source). A language keeps the terms of at least ``min_docs`` documents. Each group gives
each kept term a smoothed share in whole numbers, and two groups differ by the sum of a term function over all kept
terms. The cube has two group axes and one term axis: a task owns a cell (group block, group block, term block), gets
the slices of its two group blocks within its term block, and computes the partial divergences of its group pairs.
Partial sums are then reduced along the term axis. A slice travels to as many cells as there are group blocks.

A kept term that neither group of a pair uses has the same value for all such terms, so a cell adds up only what its own
terms differ from that value; the cells of the first term block add the value for all kept terms of the language.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches, small
from webquire.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# documents of its language that a kept term stands in, the shares' scale, and the terms listed per group
MIN_DOCS, SCALE, LISTED = 10, 1_000_000_000, 10
# groups and terms of a block; a cell holds two blocks of groups within one block of terms
GROUPS, TERMS = 32, 2_048
# counted terms a task holds before it hands them on, and bytes of a text split at once
HELD, PIECE = 200_000, 1 << 20

# terms are runs of letters A-Z in lower case and of bytes beyond ASCII; every other byte parts them
_AS_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

PARTIAL = "lang string, source string, term binary, n long, df long"
PAIR = "lang string, x string, y string, value long"


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of ``text``, some at a time."""
    text, at = text.translate(_AS_TERMS), 0
    while at < len(text):
        gap = text.find(b" ", at + PIECE)
        end = len(text) if gap < 0 else gap
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, df``: occurrences and documents of each term in each group; null values count as ``''``.

    Every group has a row with the empty term besides, with zero counts. Tasks add up their rows before the shuffle.
    """
    bounded_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    arrow = to_arrow_schema(StructType.fromDDL(PARTIAL))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms, size = [b"", *n], len(n) + 1
                columns = [[lang] * size, [source] * size, terms, [0, *n.values()], [0, *map(df.__getitem__, n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
            held.clear()

        for batch in batches:
            for lang, source, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _pieces(whole.as_py()):
                    n.update(terms)
                    seen.update(terms)
                df.update(seen)
            if sum(len(n) for n, _ in held.values()) + len(held) > HELD:
                yield from emit()
        yield from emit()

    partial = rows.mapInArrow(count, PARTIAL).withColumn("term", F.col("term").cast("string"))
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)), exact for all counts; null without kept terms."""
    whole = lambda c: c.cast("decimal(20,0)")
    above, below = whole(n + 2) * F.lit(SCALE), whole(total + 2 * v)
    return F.when(v > 0, F.call_function("div", above, below) + 1)


def _differ(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """Partial divergences of one cell's pairs; rows without a term are its groups, with the share of an absent term."""
    where = {c: table.column(c)[0].as_py() for c in ("lang", "a", "b", "tb")}
    data = {c: table.column(c).to_numpy() for c in ("own", "p", "v")}
    sources, terms = table.column("source").combine_chunks().dictionary_encode(), table.column("term").combine_chunks().dictionary_encode()
    code, names = sources.indices.to_numpy(), sources.dictionary.to_pylist()
    group = terms.is_null().to_numpy(zero_copy_only=False)
    absent, own, v = (np.zeros(len(names), dtype=np.int64) for _ in range(3))
    absent[code[group]], own[code[group]], v[code[group]] = data["p"][group], data["own"][group], data["v"][group]
    share = np.repeat(absent[:, None], len(terms.dictionary), axis=1)
    share[code[~group], terms.indices.drop_null().to_numpy()] = data["p"][~group]
    # every cell names a pair in the same order
    by_name = np.array(sorted(range(len(names)), key=names.__getitem__), dtype=np.int64)
    left, right = by_name[own[by_name] == where["a"]], by_name[own[by_name] == where["b"]]
    x, y, value = [], [], []

    def differ(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // np.maximum(p + q, 1)  # without kept terms all shares are 0

    for at, i in enumerate(left):
        others = right[at + 1 :] if where["a"] == where["b"] else right
        base = differ(absent[i], absent[others])
        part = differ(share[i], share[others]).sum(axis=1) - share.shape[1] * base
        if where["tb"] == 0:
            part += v[i] * base
        told = np.flatnonzero(part) if where["tb"] else np.arange(len(others))
        x += [names[i]] * len(told)
        y += [names[j] for j in others[told]]
        value.append(part[told])
    columns = [[where["lang"]] * len(x), x, y, np.concatenate(value) if value else []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def divergences(groups: DataFrame, counted: DataFrame, group_block: int = GROUPS, term_block: int = TERMS) -> DataFrame:
    """``lang, x, y, value``: each pair of sources of a language once, with its divergence.

    ``groups``: a row per group with its language's number of kept terms ``v`` and of groups ``n_groups``, and the
    ``absent`` share. ``counted``: the share ``p`` of every kept ``term`` that a group uses, with the group's columns.
    """
    blocks = F.ceil(F.col("n_groups") / group_block).cast("int")
    layers = F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).cast("int")
    placed = lambda df, *rest: df.select(
        "lang", "source", *rest, blocks.alias("blocks"), F.pmod(F.xxhash64("source"), blocks).cast("int").alias("own")
    )
    slices = placed(counted, "term", "p", F.lit(None).cast("long").alias("v"), F.pmod(F.xxhash64("term"), layers).cast("int").alias("tb"))
    every = F.explode(F.sequence(F.lit(0), layers - 1))
    heads = placed(groups, F.lit(None).cast("string").alias("term"), F.coalesce("absent", F.lit(0)).cast("long").alias("p"), "v", every.alias("tb"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = slices.unionByName(heads).withColumn("other", other)
    cells = cells.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "tb", "own", "source", "term", "p", F.coalesce("v", F.lit(0)).cast("long").alias("v"))
    schema = to_arrow_schema(StructType.fromDDL(PAIR))
    partial = cells.groupBy("lang", "a", "b", "tb").applyInArrow(lambda cell: _cell(cell, schema), PAIR)
    return partial.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    listed: int = LISTED,
    group_block: int = GROUPS,
    term_block: int = TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the others and from it.

    Part ``pair`` has a row per other source, furthest first, with the divergence. Part ``term`` has the ``listed`` kept
    terms that the group uses most above its language. Ties go by the item's UTF-8 bytes. Null text, language and
    source count as ``''``; every row is a document, also one that repeats. A group without terms, or a language
    without kept terms (all values 0), still has its pairs; a language with one source has none. Other columns of
    ``docs`` are left out, so their names cannot clash. An empty table gives no rows.
    """
    counts = cut(term_counts(docs, text_col, lang_col, source_col), "terms")
    of_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df"))
    kept = cut(of_lang.where(F.col("df") >= min_docs).drop("df"), "kept-terms")
    used = cut(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "used-terms")

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sizes = counts.where("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(langs, "lang", "left")
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("total", "v", "lang_total")}
    groups = known.withColumns(zero).withColumn("absent", _share(F.lit(0), F.col("total"), F.col("v")))
    groups = cut(groups, "groups")

    shares = used.join(small(groups, groups.count()), ["lang", "source"]).withColumns(
        {"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))}
    )
    pairs = divergences(groups, shares, group_block, term_block)
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    both = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_pair = both.withColumn("rank", F.row_number().over(order))
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _differ(F.col("p"), F.col("q")).alias("value"))
    by_term = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= listed)
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(by_pair, "pair").unionByName(row(by_term, "term"))
