"""What the joins of the near-duplicate search send to every executor."""

from pyspark.sql import functions as F

from webquire.llm import covering_simhash as cs


def test_exploded_fingerprints_are_not_broadcast(spark, tmp_path):
    """The file of 5,000 values is far below the limit, their 155,000 rows of masks are not."""
    spark.range(5_000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/fps")
    edges = cs.link_forest(spark.read.parquet(f"{tmp_path}/fps"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        assert edges.count() == len({tuple(sorted(e)) for e in edges.collect()})
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
