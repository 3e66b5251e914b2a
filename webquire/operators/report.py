"""Run reports: status rows per item, nested reports, and what failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webquire.operators.ranking import ranked

# --- fixed values -------------------------------------------------------------
VERSION = "1"
STATUSES = ("ok", "skipped", "error")
# items in one report object
PAGE_ITEMS = 1_000
# ------------------------------------------------------------------------------

ITEM = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("time", T.TimestampType()),
    ]
)
STEP = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("start_time", T.TimestampType()),
        T.StructField("end_time", T.TimestampType()),
        T.StructField("urls", T.ArrayType(ITEM)),
    ]
)
REPORT = T.StructType(
    [
        T.StructField("version", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("steps", T.ArrayType(STEP)),
    ]
)


def outcome_union(saved: DataFrame, errors: DataFrame) -> DataFrame:
    """Saved rows plus error rows; a column that one side lacks is NULL there."""
    return saved.unionByName(errors, allowMissingColumns=True)


def run_counts(outcomes: DataFrame) -> DataFrame:
    """``(step, saved, errors)``."""
    return outcomes.groupBy("step").agg(
        F.count_if(F.col("status") == "ok").alias("saved"), F.count_if(F.col("status") == "error").alias("errors")
    )


def report_steps(outcomes: DataFrame) -> DataFrame:
    """``(step, start_time, end_time, ok, skipped, error)``: one row per step."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return outcomes.groupBy("step").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), *counts)


def build_report(outcomes: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Nest ``(step, url, status, error, time)`` rows, unique by step and URL, into report objects.

    One layout at every size: the items of a step, in URL order, stand in objects of
    ``PAGE_ITEMS`` items (the last has fewer).  Each object is a complete report with
    one step, whose times are those of the whole step.  So no row grows with the run.
    """
    created = F.current_timestamp() if created_at is None else created_at
    placed = ranked(outcomes.select("step", "url", "status", "error", "time"), "step", "url", name="report").df
    steps = placed.groupBy("step").agg(
        F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.min("rank").alias("first_rank")
    )
    item = F.struct("url", "status", "error", "time")
    objects = (
        placed.join(steps, "step")
        .withColumn("page", F.floor((F.col("rank") - F.col("first_rank")) / PAGE_ITEMS))
        .groupBy("step", "start_time", "end_time", "page")
        .agg(F.sort_array(F.collect_list(item)).alias("urls"))
    )
    step = F.struct("step", "start_time", "end_time", "urls")
    return objects.select(
        F.lit(VERSION).alias("version"), created.alias("created_at"), F.array(step).cast(T.ArrayType(STEP)).alias("steps")
    )


def report_json(reports: DataFrame) -> DataFrame:
    """``(value)``: each report object as pretty JSON; NULL fields are left out."""
    return reports.select(
        F.to_json(F.struct(*reports.columns), {"pretty": "true", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("value")
    )


def report_items(reports: DataFrame) -> DataFrame:
    """``(step, url, status, error, time)`` rows of nested reports."""
    steps = reports.select(F.explode("steps").alias("s"))
    return steps.select(F.col("s.step").alias("step"), F.explode("s.urls").alias("u")).select("step", "u.*")


def failed_counts(reports: DataFrame) -> DataFrame:
    """``(step, failed)`` of the steps with error rows."""
    return report_items(reports).filter(F.col("status") == "error").groupBy("step").agg(F.count("*").alias("failed"))


def retry_items(items: DataFrame, reports: DataFrame, step: str, key: str = "url") -> DataFrame:
    """Items that the named step of a report lists as failed."""
    failed = report_items(reports).filter((F.col("step") == step) & (F.col("status") == "error"))
    return items.join(failed.select(F.col("url").alias(key)), key, "left_semi").select(items.columns)
