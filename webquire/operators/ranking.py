"""Dense ranks over a distributed sort, without a single-task window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquire.session import cut

PARTITION_BITS = 33


@dataclass
class Ranked:
    """A sorted, written copy with an order-keeping row number ``rank`` (from 1)."""

    df: DataFrame
    count: int


def partition_sizes(df: DataFrame, row_id: str = "row_id") -> dict[int, int]:
    """Rows per sort partition of a written table with sorted row ids; one entry per partition."""
    part = F.shiftright(row_id, PARTITION_BITS).alias("part")
    return {r["part"]: r["n"] for r in df.groupBy(part).agg(F.count("*").alias("n")).collect()}


def nth_row_id(sizes: dict[int, int], n: int) -> int:
    """Row id of the ``n``-th row in sort order (``n`` from 1)."""
    for part in sorted(sizes):
        if n <= sizes[part]:
            return (part << PARTITION_BITS) + n - 1
        n -= sizes[part]
    raise ValueError("fewer rows than asked for")


def ranked(df: DataFrame, *order: Column | str, name: str = "ranked", start: int = 0) -> Ranked:
    """Sort by ``order`` (which must be unique) and number the rows from ``start + 1``.

    A row's id holds its sort partition and its place inside it.  The copy is
    written, so the ids are fixed; the driver then sees one count per sort
    partition, and the offsets go back as an array of that size, read by position.
    """
    wide = cut(df.orderBy(*order).withColumn("row_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("row_id", PARTITION_BITS)
    sizes = partition_sizes(wide)
    offsets, total = [0] * (max(sizes, default=-1) + 1), 0
    for p in sorted(sizes):
        offsets[p] = start + total
        total += sizes[p]
    if not sizes:
        return Ranked(wide.withColumn("rank", F.lit(None).cast("bigint")).drop("row_id"), 0)
    place = F.col("row_id").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    rank = F.get(F.lit(offsets).cast("array<bigint>"), part.cast("int")) + place + 1
    return Ranked(wide.withColumn("rank", rank.cast("bigint")).drop("row_id"), total)
