"""Mixing leaves the texts where they are: one row per source goes to them."""

from pyspark.sql import functions as F

from pathloom.llm import mixing


def test_texts_are_not_shuffled_by_source(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the targets' estimate were large
    try:
        docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
        plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        rows = mixing.with_copies(docs)[0].groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count(F.lit(1)).alias("n")).collect()
        assert len(rows) == 4 and sum(r["n"] for r in rows) == 300 and all(r["taken"] is not None and r["target"] > 0 for r in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
