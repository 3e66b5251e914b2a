"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Every bit position gets a random non-zero vector of ``radius + 1`` bits. For each of the ``2^(radius+1) - 1`` non-zero
vectors ``v`` there is a table whose mask holds the positions with odd inner product with ``v``. The vectors of at most
``radius`` differing positions never span the whole space, so some ``v`` is orthogonal to all of them: its mask keeps
none of the positions, and the pair agrees under it. Every pair within the radius meets in some table.

Equal fingerprints are one row from the start. Buckets never emit their pairs: a bucket is cut into blocks of bounded
size, each pair of blocks is a group, and a group emits the edges of a spanning forest of its links. The forest has the
same components as the links. Components come from alternating large-star and small-star rounds over the edges.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import WORD, bounded_batches
from webquire.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 64
RADIUS = 4
SHINGLE = 4
HASH_SEED = 42
# Fingerprints of a bucket in one block; a group compares two blocks.
BLOCK = 2_048
# Shingle hashes whose bits are counted at once.
HASHES = 1 << 14

_words = re.compile(WORD).findall
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's SimHash as an unsigned number; 0 without words."""
    words = _words((text or "").translate(_LOWER))
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES):
        h = np.array([digest(" ".join(words[i : i + shingle]), HASH_SEED) for i in range(at, min(n, at + HASHES))], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp`` (the fingerprint's bits as a signed long) for every row."""
    bounded_batches(docs.sparkSession)
    schema = StructType([docs.schema[id_col], *StructType.fromDDL("fp long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, seed: int = 11) -> list[int]:
    """``2^(radius+1) - 1`` masks of ``BITS`` bits: any ``radius`` positions are all outside one of them.

    The vectors of the positions are dealt evenly, in a random order, so that the masks have about half the bits each.
    """
    n = (1 << radius + 1) - 1
    vectors = np.random.default_rng(seed).permutation(np.arange(BITS) % n + 1)
    return [sum(1 << i for i, m in enumerate(vectors) if int(m & v).bit_count() & 1) for v in range(1, n + 1)]


def _forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that connect what links of ``radius`` connect: within ``left``, or between ``left`` and ``right``."""
    nodes = left if right is None else np.concatenate([left, right])
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        for j in np.flatnonzero(np.bitwise_count(nodes[start:] ^ nodes[i]) <= radius) + start:
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, int(j)))
    return [(int(nodes[i]), int(nodes[j])) for i, j in edges]


def link_forest(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges among the distinct values ``fp`` whose components are those of all links within ``radius``."""
    masks = covering_masks(radius)
    to_long = lambda m: m - (1 << BITS) if m >> BITS - 1 else m
    tables = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(to_long(m))).alias("key")) for t, m in enumerate(masks))))
    keyed = fps.select("fp", tables.alias("k")).select("k.t", "k.key", "fp")
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # Spark takes the exploded rows for about as many as before and would broadcast all of them
    placed = keyed.hint("merge").join(buckets, ["t", "key"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    grouped = placed.withColumn("other", other).select("t", "key", "fp", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    schema = StructType.fromDDL("a long, b long")
    arrow = to_arrow_schema(schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups arrive sorted, each in one stretch of at most about two blocks."""

        def close(rows: list[np.ndarray], p: int, q: int) -> list[tuple[int, int]]:
            fp, own = np.concatenate([r[0] for r in rows]).view(np.uint64), np.concatenate([r[1] for r in rows])
            return _forest(fp, None, radius) if p == q else _forest(fp[own == p], fp[own == q], radius)

        held, key, edges = [], None, []

        def emit() -> Iterator[pa.RecordBatch]:
            if edges:
                ends = np.array(edges, dtype=np.uint64).view(np.int64)
                edges.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], schema=arrow)

        for batch in batches:
            c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "key", "p", "q", "fp", "own")}
            changed = np.flatnonzero((np.diff(c["t"]) != 0) | (np.diff(c["key"]) != 0) | (np.diff(c["p"]) != 0) | (np.diff(c["q"]) != 0)) + 1
            for a, b in zip([0, *changed], [*changed, batch.num_rows]):
                now = tuple(int(c[n][a]) for n in ("t", "key", "p", "q"))
                if held and now != key:
                    edges += close(held, *key[2:])
                    held = []
                    if len(edges) > 50_000:
                        yield from emit()
                key = now
                held.append((c["fp"][a:b], c["own"][a:b]))
        if held:
            edges += close(held, *key[2:])
        yield from emit()

    return grouped.repartition("t", "key", "p", "q").sortWithinPartitions("t", "key", "p", "q").mapInArrow(compare, schema).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: for every node of an edge the smallest node of its component.

    Large-star and small-star rounds (logarithmic in practice), each a written table. A round needs only minima and
    joins on narrow rows; the minima are written too, so that AQE's skew join can split a node with very many edges.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "cc")
    before = None
    while (state := now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before:
        before = state
        # every neighbour above a node moves to the node's smallest neighbour
        both = now.select("u", "v").union(now.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "x"), "cc-low")
        large = both.join(low, both["u"] == low["x"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every smaller neighbour, and the node itself, moves to the smallest one
        large = cut(large, "cc-large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x"), "cc-least")
        moved = large.join(least, large["u"] == least["x"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.union(least.select("x", "m")).where("u <> v").distinct(), "cc")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(now.select("v", "v").distinct())


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp, root, component_id`` for every row; ``root`` names the component among fingerprints."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = cut(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "simhash-classes")
    of = components(link_forest(classes.select("fp"), radius))
    linked = cut(classes.join(of, classes["fp"] == of["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    names = cut(linked.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id")), "simhash-names")
    named = linked.join(names, linked["root"] == names["r"]).select(F.col("fp").alias("f"), "root", "component_id")
    return rows.join(named, rows["fp"] == named["f"]).select(id_col, "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row.

    ``component_id`` is the smallest id that links of at most ``radius`` differing bits reach. Texts without words
    (null included) have fingerprint zero and link like any other. Null ids keep their rows and name no component, so
    one of null ids alone has a null ``component_id``. Repeated rows share a component. Other columns of ``docs`` are
    left out, so their names cannot clash. An empty table gives no rows.
    """
    return groups(docs, id_col, text_col, radius, shingle).select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, in its own columns.

    It is the row with the smallest id; of rows that share this id, the first by text and then by the other columns. A
    group without any id keeps one row in the same order. Rows that share an id may be in different groups.
    """
    row = F.struct(F.col(id_col).isNull().alias("nameless"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("which"))  # ids before null
    found = cut(groups(docs.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text", radius), "simhash-groups")
    first = found.where(F.col("row.id").eqNullSafe(F.col("component_id.id")))
    first = cut(first.select(F.col("row.id").alias("__id"), F.col("row.which").alias("__which"), F.col("root").alias("__root")).distinct(), "simhash-first")
    known = docs.join(first, docs[id_col].eqNullSafe(first["__id"]) & (F.xxhash64(docs[text_col]) == first["__which"]))
    sortable = [c for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind and "variant" not in kind]
    # an aggregate, not a window: its partial results keep a large group out of one task
    best = F.min_by(F.struct(*(docs[f"`{c}`"] for c in docs.columns)), F.struct(*(docs[f"`{c}`"] for c in (text_col, *sortable)))).alias("__row")
    return known.groupBy("__root").agg(best).select("__row.*")
