"""Exact top-k inner products over an impact-ordered index, score at a time.

Components become whole numbers. The index holds, per block of vectors, one posting segment per quantised impact (the
size of a component in ``LEVELS`` steps) and dimension: the vectors of the block with such a component, and its value.
A search reads a block's segments by descending impact and adds each to the scores of a batch of queries. After a level,
what a vector can still gain or lose is at most the length of its unread part times the query's length (Cauchy-Schwarz).
A query stops when this proves that all but a few vectors of the block are below its ``k + 1`` best; those few are scored
again from all their components. Without such a proof it reads all segments, and its scores are exact then.

Equal vectors are one class, listed with its ``k + 1`` smallest ids; no other row of a class can be among a query's ``k``
best. So a vector that a third of all rows share is one posting, and classes fill the blocks evenly. Queries are dealt
in groups; a cell (block of the index, group of queries) is one task's work, and only its best rows leave it.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from webquire.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, TOP = 256, 5
# steps of an impact; classes of a block; queries of a group, and of a batch whose scores stand in memory together
LEVELS, BLOCK, QUERIES, BATCH = 16, 8_192, 8_192, 256
# a query stops once no more vectors of the block than this can be among its best
POSSIBLE = 64
# components beyond are taken as this, so that scores fit a long
LARGEST = 1 << 26


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, v``: floor(``scale`` * component) of each vector that is not null and holds finite components only.

    Components beyond ``LARGEST`` count as it. Zeros at the end are left out, as they score nothing.
    """
    usable = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    number = lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    whole = vectors.where(usable).select(F.col(id_col).alias("id"), F.transform(vec_col, number).alias("v"))
    end = F.coalesce(F.array_max(F.transform("v", lambda x, i: F.when(x != 0, i + 1).otherwise(0))), F.lit(0))
    return whole.select("id", F.slice("v", F.lit(1), end).alias("v"))


def classes(whole: DataFrame, top: int = TOP) -> DataFrame:
    """``v, names``: each different vector with its ``top + 1`` smallest ids, null last."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id")))
    first = whole.withColumn("nth", nth).where(F.col("nth") <= top + 1)
    names = F.transform(F.array_sort(F.collect_list(F.struct("nth", "id"))), lambda x: x["id"])
    return first.groupBy("v").agg(names.alias("names"))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in its row, and value of every entry of a list column."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), lists.flatten().to_numpy().astype(np.int64)


def _segments(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The posting segments of one block, and a row without level that names its vectors."""
    who, dim, value = _flat(table.column("v"))
    posted = value != 0
    who, dim, value = who[posted], dim[posted], value[posted]
    impact = np.abs(value)
    level = impact * LEVELS // (int(impact.max(initial=0)) + 1)
    order = np.lexsort((who, dim, -level))
    who, dim, value, level = who[order], dim[order], value[order], level[order]
    starts = np.flatnonzero((np.diff(level, prepend=-1) != 0) | (np.diff(dim, prepend=-1) != 0))
    offsets = pa.array([*starts, len(who)], pa.int32())
    listed = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32)))
    block, n = table.column("block")[0].as_py(), len(starts)
    none = lambda f, size: pa.nulls(size, f.type)
    of = {f.name: f for f in schema}
    segments = [pa.array([block] * n, pa.int32()), pa.array(level[starts], pa.int32()), pa.array(dim[starts], pa.int32()), listed(who), listed(value), none(of["names"], n)]
    head = [pa.array([block], pa.int32()), *(none(of[c], 1) for c in ("level", "dim", "who", "value")), pa.array([table.column("names").to_pylist()], of["names"].type)]
    return pa.concat_tables(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(part, schema)], schema=schema) for part in (segments, head))


def impact_index(whole: DataFrame, top: int = TOP, block: int = BLOCK) -> tuple[DataFrame, int]:
    """The written index ``block, level, dim, who, value, names`` and its number of blocks.

    ``who`` are places in the block. The row without ``level`` holds in ``names`` the ids at each place.
    """
    named = cut(classes(whole, top), "vector-classes")
    blocks = max(1, -(-named.count() // block))
    number, ints = T.IntegerType(), T.ArrayType(T.IntegerType())
    kinds = {"block": number, "level": number, "dim": number, "who": ints, "value": ints, "names": T.ArrayType(named.schema["names"].dataType)}
    schema = T.StructType([T.StructField(c, k) for c, k in kinds.items()])
    arrow = to_arrow_schema(schema)
    placed = named.withColumn("block", F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int"))
    return cut(placed.groupBy("block").applyInArrow(lambda table: _segments(table, arrow), schema), "impact-index"), blocks


def _possible(score: np.ndarray, rest: np.ndarray, lengths: np.ndarray, slack: float, top: int) -> np.ndarray:
    """Which vectors can be among the ``top + 1`` best of each query, whatever their unread parts hold."""
    change = rest[:, None] * lengths[None, :] + slack
    if len(score) <= top + 1:
        return np.ones(score.shape, dtype=bool)
    proven = np.partition(score - change, len(score) - top - 1, axis=0)[len(score) - top - 1]
    return score + change >= proven


def _search(index: pa.Table, queries: pa.Table, schema: pa.Schema, top: int) -> pa.Table:
    """The best rows of one block for a group of queries."""
    out: list[list] = [[] for _ in schema]
    if not index.num_rows or not queries.num_rows:
        return pa.Table.from_pylist([], schema=schema)
    heads = pa.compute.is_null(index.column("level"))
    names = index.filter(heads).column("names")[0].as_py()
    posted = index.filter(pa.compute.invert(heads)).sort_by([("level", "descending"), ("dim", "ascending")])
    level, dim = posted.column("level").to_numpy(), posted.column("dim").to_numpy()
    segment, _, who = _flat(posted.column("who"))
    value = _flat(posted.column("value"))[2]
    starts = np.searchsorted(segment, np.arange(len(level) + 1))
    asked, place, component = _flat(queries.column("v"))
    width = max(int(dim.max(initial=-1)), int(place.max(initial=-1))) + 1
    vectors, wanted = np.zeros((len(names), width), dtype=np.int64), np.zeros((queries.num_rows, width), dtype=np.int64)
    vectors[who, dim[segment]] = value
    wanted[asked, place] = component
    largest = float(np.abs(wanted).max(initial=0)) * float(np.abs(vectors).sum(axis=1).max(initial=0))
    # whole numbers up to 2^24 and 2^53 are exact in these; beyond, the bounds get the error
    kind, slack = (np.float32, 0.0) if largest < 1 << 24 else (np.float64, 0.0 if largest < 1 << 53 else largest * 2.0**-40)

    # the segments of a level, and the length of what each vector still has below it
    stages, rest = [], (vectors.astype(np.float64) ** 2).sum(axis=1)
    bounds = [0, *(np.flatnonzero(np.diff(level)) + 1), len(level)] if len(level) else [0, 0]
    for a, b in zip(bounds, bounds[1:]):
        these = slice(starts[a], starts[b])
        np.subtract.at(rest, who[these], value[these].astype(np.float64) ** 2)
        stages.append((range(a, b), starts[b], np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9)))
    who, value = who.astype(np.int32), value.astype(kind)
    asking = queries.select(["id", "copies", "query"]).to_pylist()

    def answer(q: int, possible: np.ndarray) -> None:
        exact = vectors[possible] @ wanted[q]
        best = sorted(zip((-exact).tolist(), possible.tolist()), key=lambda x: (x[0], _order(names[x[1]][0])))[: top + 1]
        found = []
        for minus, i in best:
            own = names[i]
            if asking[q]["id"] in own and np.array_equal(vectors[i], wanted[q]):
                own = list(own)
                own.remove(asking[q]["id"])
            found += [(minus, _order(x), x) for x in own]
        for minus, _, x in sorted(found, key=lambda f: f[:2])[:top]:
            for column, item in zip(out, (asking[q]["id"], asking[q]["query"], asking[q]["copies"], x, -minus)):
                column.append(item)

    for first in range(0, len(wanted), BATCH):
        left = np.arange(first, min(first + BATCH, len(wanted)))
        weights = np.ascontiguousarray(wanted[left].T).astype(kind)
        lengths = np.sqrt((wanted[left].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
        score = np.zeros((len(names), len(left)), dtype=kind)
        for segments, read, unread in stages:
            for s in segments:
                these = slice(starts[s], starts[s + 1])
                score[who[these]] += value[these, None] * weights[dim[s]]
            done = read == len(who)
            if not done and 2 * read < len(who):
                continue  # half of the postings prove nothing yet
            can = _possible(score, np.zeros(len(unread)) if done else unread, lengths, slack, top)
            stop = np.full(len(left), True) if done else can.sum(axis=0) <= POSSIBLE
            for j in np.flatnonzero(stop):
                answer(left[j], np.flatnonzero(can[:, j]))
            if stop.all():
                break
            if stop.any():
                left, lengths = left[~stop], lengths[~stop]
                weights, score = np.ascontiguousarray(weights[:, ~stop]), np.ascontiguousarray(score[:, ~stop])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _order(name: object) -> tuple:
    """Ids in order, null last."""
    return (name is None, 0 if name is None else name)


def top_products(
    vectors: DataFrame,
    is_query: Column,
    top: int = TOP,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    scale: int = SCALE,
    block: int = BLOCK,
    group: int = QUERIES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` holds for, the ``top`` other rows by score.

    ``is_query`` is a condition on ``id_col``. The score is the inner product of floor(``scale`` * component), exact;
    ties go to the smaller id, null last. All rows but the query's own are candidates, also its copies. Vectors that
    are null or hold null or non-finite components take no part. Vectors of unlike lengths are compared as if zeros
    followed the shorter one; an empty vector scores 0. A query row that repeats has its answer as often; rows with
    one id and unlike vectors are queries of their own. Other columns are left out, so their names cannot clash. An
    empty table gives no rows.
    """
    whole = cut(whole_vectors(vectors, id_col, vec_col, scale), "whole-vectors")
    index, blocks = impact_index(whole, top, block)
    asked = whole.withColumnRenamed("id", id_col).where(is_query).groupBy(F.col(id_col).alias("id"), "v").agg(F.count(F.lit(1)).alias("copies"))
    asked = cut(asked.withColumn("query", F.xxhash64("id", "v")), "queries")
    groups = max(1, -(-asked.count() // group))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("part", number(groups))
    right = asked.withColumn("part", F.pmod("query", F.lit(groups)).cast("int")).withColumn("block", number(blocks))
    kind = whole.schema["id"].dataType
    schema = T.StructType([T.StructField(c, kind if c in ("id", "vec_id") else T.LongType()) for c in ("id", "query", "copies", "vec_id", "score")])
    arrow = to_arrow_schema(schema)
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(lambda x, y: _search(x, y, arrow, top), schema)
    nth = F.row_number().over(Window.partitionBy("id", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    best = found.withColumn("rank", nth).where(F.col("rank") <= top)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return best.select(F.col("id").alias("query_id"), "rank", "vec_id", "score", copies.alias("copy")).drop("copy")
