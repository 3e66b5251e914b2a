"""Line deduplication by a log-template tree.

A line's words are parsed down a tree of fixed depth: the number of words, then the ``LEADING`` first words, where a word
with a digit is the variable field ``<*>``. In a leaf, lines are compared position by position with the templates so
far; one that shares ``SIMILARITY`` of its words with a template joins it, and positions that differ become ``<*>``.
A template that occurs in ``min_docs`` documents or more is dropped from all of them but the first.

Only leaves that occur in two documents can hold such a template, so the others leave at once, as hashes. In a leaf the
distinct lines are clustered in blocks of bounded size, most frequent first. Then templates that share ``SIMILARITY`` of
their words are linked, and the templates of a component are one. A leaf of one block is linked where it is clustered.
Else links are sought between bounded blocks: templates of a large leaf meet only where they agree on one of so many
segments of their words that two similar ones must agree on some.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches, flush, small
from webquire.llm.covering_simhash import components
from webquire.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEADING = 4
# Shorter lines are no template and stay, unless the caller sets another limit; up to three words, alike means equal.
MIN_WORDS = 4
# Share of equal words, in percent.
SIMILARITY = 70
MIN_DOCS = 2
# Lines of a leaf in one block, and their words; a group compares two blocks at most.
BLOCK = 256
BLOCK_WORDS = 1 << 20
FIELD = "<*>"
SPACE = r"[\x20\x09-\x0D]+"


def masked(line: Column) -> Column:
    """The line's words with ``FIELD`` for those that hold a digit."""
    fields = F.regexp_replace(line, r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+", FIELD)
    return F.array_remove(F.split(F.when(line.rlike("[0-9]"), fields).otherwise(line), SPACE), "")


def line_hashes(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Hash of the masked words of every line of ``text``; null for lines of fewer than ``min_words`` words."""
    return F.transform(F.split(text, "\n"), lambda x: F.transform(F.array(masked(x)), lambda w: F.when(F.size(w) >= min_words, F.xxhash64(w)))[0])


def generalise(groups: DataFrame) -> DataFrame:
    """``leaf, v, t, top, template``: the cluster ``t`` of every row ``leaf, block, v, words, n``, named by its first member.

    ``template`` is set on the row with ``v = t``. Clusters form within ``(leaf, block)``, in the order of falling ``n``;
    ``top`` is the smallest name that links of similar templates reach there.
    """
    schema = StructType.fromDDL("leaf long, v long, t long, top long, template string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, templates, members, rows = None, [], [], []  # templates: name and words
        places: dict[tuple[int, str], list[int]] = {}  # templates by the word at a position

        def close() -> None:
            top = {b: a for a, b in linked([t for t, _ in templates], coded([words for _, words in templates]))} if len(templates) > 1 else {}
            rows.extend((key[0], t, t, top.get(t, t), " ".join(words)) for t, words in templates)
            rows.extend((key[0], v, t, top.get(t, t), None) for v, t in members)
            templates.clear()
            members.clear()
            places.clear()

        def candidates(words: list[str], need: int) -> list[int]:
            """Templates that can share ``need`` words: of any ``len - need + 1`` positions one must agree, so the rarest do."""
            found = sorted((places.get(p, ()) for p in enumerate(words)), key=len)[: len(words) - need + 1]
            return sorted({i for part in found for i in part})

        for batch in batches:
            for leaf, block, v, words in zip(*(batch.column(c).to_pylist() for c in ("leaf", "block", "v", "words"))):
                if (leaf, block) != key:
                    if key is not None:
                        close()
                    key = (leaf, block)
                    if len(rows) >= 20_000:
                        yield from flush(rows, arrow)
                words = words.split(" ")
                best, most = None, -(-len(words) * SIMILARITY // 100)
                for i in candidates(words, most):
                    same = sum(map(str.__eq__, templates[i][1], words))
                    if same >= most and (best is None or same > most):
                        best, most = i, same
                if best is None:
                    for p in enumerate(words):
                        places.setdefault(p, []).append(len(templates))
                    templates.append((v, words))
                else:
                    t, template = templates[best]
                    for i, (a, b) in enumerate(zip(template, words)):
                        if a != b and a != FIELD:
                            template[i] = FIELD
                            places.setdefault((i, FIELD), []).append(best)
                    members.append((v, t))
        if key is not None:
            close()
        yield from flush(rows, arrow)

    return groups.repartition("leaf", "block").sortWithinPartitions("leaf", "block", F.desc("n"), "words", "v").select("leaf", "block", "v", "words").mapInArrow(run, schema)


def spanning(left: np.ndarray, right: np.ndarray | None, need: int) -> list[tuple[int, int]]:
    """Pairs of rows that connect what pairs with ``need`` equal columns connect: within ``left``, or from it to ``right``."""
    rows = left if right is None else np.concatenate([left, right])
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    pairs = []
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        for j in np.flatnonzero(np.count_nonzero(rows[start:] == rows[i], axis=1) >= need).tolist():
            a, b = root(i), root(start + j)
            if a != b:
                parent[b] = a
                pairs.append((i, start + j))
    return pairs


def coded(lines: list[list[str]]) -> np.ndarray:
    """A row of numbers for every line of equally many words; equal words have equal numbers."""
    codes: dict[str, int] = {}
    return np.array([[codes.setdefault(w, len(codes)) for w in words] for words in lines], dtype=np.int32)


def linked(names: list[int], left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The smallest name of every component of similar rows (``spanning``) with each of its other names; names are of ``left``, then ``right``."""
    root: dict[int, int] = {}

    def low(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    for i, j in spanning(left, right, -(-left.shape[1] * SIMILARITY // 100)):
        a, b = low(names[i]), low(names[j])
        root[max(a, b)] = min(a, b)
    return [(low(v), v) for v in root if low(v) != v]


def compare_blocks(groups: DataFrame) -> DataFrame:
    """``a, b``: edges whose components are those of the similar templates of every group ``leaf, key, p, q`` of rows ``own, v, words``.

    They are stars, so that few rounds find the components of all groups. A group holds the blocks ``p`` and ``q`` of a key; ``own`` tells which of them a row is from.
    """
    schema = StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, edges = None, [], []

        def close() -> None:
            names = [v for v, _, _ in held]
            table = coded([words.split(" ") for _, _, words in held])
            if key[2] == key[3]:
                edges.extend(linked(names, table))
            else:
                own = np.array([o for _, o, _ in held])
                first, other = np.flatnonzero(own == key[2]), np.flatnonzero(own == key[3])
                edges.extend(linked([names[i] for i in [*first, *other]], table[first], table[other]))
            held.clear()

        for batch in batches:
            for *group, own, v, words in zip(*(batch.column(c).to_pylist() for c in ("leaf", "key", "p", "q", "own", "v", "words"))):
                if group != key:
                    if held:
                        close()
                        if len(edges) >= 20_000:
                            yield from flush(edges, arrow)
                    key = group
                held.append((v, own, words))
        if held:
            close()
        yield from flush(edges, arrow)

    keys = ("leaf", "key", "p", "q")
    return groups.select(*keys, "own", "v", "words").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def n_blocks(rows: Column, size: Column) -> Column:
    """Blocks for ``rows`` lines of ``size`` words each."""
    return F.ceil(F.greatest(rows / BLOCK, rows * size / BLOCK_WORDS))


def similar(templates: DataFrame) -> DataFrame:
    """``a, b``: edges among ``v`` of the rows ``leaf, v, words`` whose components are those of all similar pairs in a leaf.

    All lines of a leaf share its leading words, so similar ones differ in at most ``d`` of the other positions, and of
    ``d + 1`` segments of these one agrees. A leaf of one block needs no segments.
    """
    sizes = templates.groupBy(F.col("leaf").alias("l")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowd = templates.join(sizes, F.col("leaf") == F.col("l")).withColumn("w", F.split("words", " ")).withColumn("size", F.size("w"))
    parts = F.floor(F.col("size") * (100 - SIMILARITY) / 100).cast("int") + 1
    edge = lambda s: F.least(F.lit(LEADING), "size") + F.floor(s * F.greatest(F.col("size") - LEADING, F.lit(0)) / parts).cast("int")
    segment = lambda s: F.xxhash64(s, F.slice("w", edge(s) + 1, edge(s + 1) - edge(s)))
    keys = F.when(n_blocks(F.col("n"), F.col("size")) <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), segment))
    keyed = cut(crowd.select("leaf", "v", "size", F.explode(keys).alias("key")), "line-keys")
    buckets = keyed.groupBy(F.col("leaf").alias("l"), F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = keyed.join(buckets, (F.col("leaf") == F.col("l")) & (F.col("key") == F.col("k"))).withColumn("blocks", n_blocks(F.col("n"), F.col("size")).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")).select(F.col("leaf").alias("l"), F.col("v").alias("x"), "key", "blocks", "own")
    worded = templates.join(placed, (F.col("leaf") == F.col("l")) & (F.col("v") == F.col("x"))).select("leaf", "v", "words", "key", "blocks", "own")
    paired = worded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return compare_blocks(paired.select("leaf", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "v", "words"))


def clusters(variants: DataFrame) -> DataFrame:
    """``leaf, v, top``: the template of every row ``leaf, v, words, n``, named by a member; alike for leaves of every size."""
    sizes = variants.groupBy(F.col("leaf").alias("l")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(F.split("words", " "))).alias("size"))
    large = cut(sizes.select("l", n_blocks(F.col("rows"), F.col("size")).alias("blocks")).where("blocks > 1"), "line-sizes")
    crowded = large.count()
    large = small(large, crowded)
    blocked = variants.join(large, F.col("leaf") == F.col("l"), "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("v"), F.col("blocks")), F.lit(0)))
    first = cut(generalise(blocked), "line-templates")
    if not crowded:
        return first.select("leaf", "v", "top")
    many = first.join(large, F.col("leaf") == F.col("l"), "left_semi")
    of = components(similar(many.where("template is not null").select("leaf", "v", F.col("template").alias("words"))))
    many = many.join(of, F.col("t") == F.col("node"), "left").select("leaf", "v", F.coalesce("root", "t").alias("top"))
    return many.unionByName(first.join(large, F.col("leaf") == F.col("l"), "left_anti").select("leaf", "v", "top"))


def recurring(docs: DataFrame, id_col: str, text_col: str, min_docs: int, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """``v, t, first_doc`` of the masked lines whose template recurs, and ``v, doc`` of their occurrences."""
    doc = F.col(id_col).alias("doc")
    lines = docs.select(doc, F.explode(F.split(text_col, "\n")).alias("line"))
    # exploded, so that the words are made once: a filter on a plain column would be pushed below it and make them twice
    lines = lines.select("doc", F.explode(F.array(masked(F.col("line")))).alias("w")).where(F.size("w") >= max(1, min_words))
    # one pass over the texts; what follows reads the columns that it needs
    lines = cut(lines.select("doc", F.xxhash64(F.size("w"), F.slice("w", 1, LEADING)).alias("leaf"), F.xxhash64("w").alias("v"), F.array_join("w", " ").alias("words")), "lines")
    some, other = F.min("doc"), F.max("doc")
    leaves = lines.groupBy("leaf").agg(some.alias("a"), other.alias("b"), F.bool_or(F.col("doc").isNull()).alias("z")).where("a <> b or (z and a is not null)")
    leaves = cut(leaves.select(F.col("leaf").alias("l")), "line-leaves")
    shared = lines.join(small(leaves, leaves.count()), F.col("leaf") == F.col("l"), "left_semi")
    # another number for the leaf: grouping deals the rows anew, so the join may split a hot leaf
    shared = shared.select("doc", F.bitwise_not("leaf").alias("leaf"), "v", "words")
    at = cut(shared.groupBy("leaf", "v", "doc").agg(F.count(F.lit(1)).alias("n")).select("leaf", "v", "doc"), "line-docs")
    texts = shared.groupBy("leaf", "v").agg(F.first("words").alias("words"))
    counts = at.groupBy(F.col("leaf").alias("l"), F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first_doc"))
    variants = cut(texts.join(counts, (F.col("leaf") == F.col("l")) & (F.col("v") == F.col("x"))).select("leaf", "v", "words", "n", "first_doc"), "line-variants")
    of = clusters(variants).select(F.col("leaf").alias("l"), F.col("v").alias("x"), "top")
    member = variants.join(of, (F.col("leaf") == F.col("l")) & (F.col("v") == F.col("x"))).select("leaf", "v", "top", "n", "first_doc")
    member = cut(member, "line-members")
    top = member.groupBy(F.col("leaf").alias("l"), F.col("top").alias("x")).agg(F.sum("n").alias("docs"), F.min("first_doc").alias("first"), F.max("first_doc").alias("last"), F.max("n").alias("most"), F.bool_or(F.col("first_doc").isNull()).alias("nameless"))
    top = top.where((F.col("most") > 1) | (F.col("first") < F.col("last")) | (F.col("nameless") & F.col("first").isNotNull()))  # two documents
    if min_docs > 2:
        # a template's documents are at least its commonest variant's and at most all of them; only those between are counted
        top = cut(top.where(F.col("docs") >= min_docs), "line-tops")
        unsure = top.where(F.col("most") < min_docs).select("l", "x")
        given = member.join(unsure, (F.col("leaf") == F.col("l")) & (F.col("top") == F.col("x"))).select(F.col("leaf").alias("l"), F.col("v").alias("y"), "x")
        given = at.join(given, (F.col("leaf") == F.col("l")) & (F.col("v") == F.col("y"))).select("l", "x", "doc").distinct()
        enough = given.groupBy("l", "x").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("l", "x")
        top = top.where(F.col("most") >= min_docs).unionByName(top.where(F.col("most") < min_docs).join(enough, ["l", "x"]))
    found = member.join(top.select("l", "x", "first"), (F.col("leaf") == F.col("l")) & (F.col("top") == F.col("x"))).select("leaf", "v", "top", F.col("first").alias("first_doc"))
    return cut(found, "line-recurring"), at


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, and ``n_lines`` and ``n_dropped``, which replace columns of these names.

    A template stays in the document with the smallest id and goes from the others. It needs ``min_docs`` documents, at
    least two; a document counts once, however many variants it gives. Lines of fewer than ``min_words`` words, and those
    of none, stay. Null texts stay null with no
    lines; rows that share an id (null included) are one document; a null id is never the first. An empty table gives
    no rows.
    """
    bounded_batches(docs.sparkSession)
    found, at = recurring(docs, id_col, text_col, min_docs, min_words)
    hits = at.join(found.select(F.col("leaf").alias("l"), F.col("v").alias("x"), "first_doc"), (F.col("leaf") == F.col("l")) & (F.col("v") == F.col("x")))
    goes = hits.where(~F.col("doc").eqNullSafe(F.col("first_doc"))).groupBy(F.col("doc").alias("__doc")).agg(F.collect_set("v").alias("__drop"))  # bounded by a document's lines
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(*kept).join(goes, F.col(id_col).eqNullSafe(F.col("__doc")), "left").drop("__doc").withColumn("__lines", F.when(F.col("__drop").isNotNull(), line_hashes(F.col(text_col), max(1, min_words))))
    schema = StructType([*(docs.schema[c] for c in kept), *StructType.fromDDL("n_lines int, n_dropped int")])
    arrow = to_arrow_schema(schema)
    place = kept.index(text_col)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop, hashes in zip(*(batch.column(c) for c in (text_col, "__drop", "__lines"))):
                text, drop, dropped = text.as_py(), drop.as_py(), 0
                lines = [] if text is None else text.split("\n")
                n_lines.append(len(lines))
                if drop and text is not None:
                    gone = set(drop)
                    left = [x for x, h in zip(lines, hashes.as_py()) if h not in gone]
                    dropped, text = len(lines) - len(left), "\n".join(left)
                texts.append(text)
                n_dropped.append(dropped)
            columns = [batch.column(c) for c in kept]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_dropped, pa.int32())], schema=arrow)

    return rows.mapInArrow(rebuild, schema)
