"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A word: a run of code points other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
# Rows of a written table below which it is broadcast; each of its rows is narrow.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Words in ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep an Arrow batch small whatever the texts' lengths: few rows, and a limit in bytes where Spark has one.

    The settings are the session's and stay, as the plan that needs them runs later.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` stay within ``limit``, else as it is for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def flush(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``rows`` as one batch; empties the list."""
    if rows:
        columns = list(zip(*rows))
        rows.clear()
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
