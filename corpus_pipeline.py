"""A corpus pipeline over ``documents``: each stage's result is written as Parquet and read as the next one's ``docs``.

toxicity (rejected documents go), near-duplicates (one document of each group stays), benchmark decontamination
(documents that hold an item go), mixing (documents are repeated, kept or left out by their source's target), token
shards (the index of the written shards, a row per sequence in training order).

All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquire.llm.common import table
from webquire.llm.covering_simhash import keep_one
from webquire.llm.factorization import toxicity
from webquire.llm.mixing import draw
from webquire.llm.template_decontam import decontaminate
from webquire.llm.token_shards import write_shards
from webquire.session import cut

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = toxicity(docs, table(spark, sf_dir, "labels"), score_col="__score", predicted_col="__rejected")
    return judged.where(F.col("__rejected") == 0).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return draw(docs)


def shard_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return write_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_shards", shard_tokens),
]

# The model, the components and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
