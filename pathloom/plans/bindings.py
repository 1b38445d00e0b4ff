"""The driver's tables as movement tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL of the same tables, to be put in front of an oracle.
TRAJ = "traj AS (SELECT user_id AS run, event_id AS id, epoch(ts)::DOUBLE AS t, value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS y, event_type AS kind FROM events)"
CLOUD = "cloud AS (SELECT vec_id AS pid, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS r, embedding[5]::DOUBLE AS g, embedding[6]::DOUBLE AS b, embedding[7]::DOUBLE AS conf, label AS frame FROM embeddings)"
EDGES = "edges AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_partkey AS i, l_suppkey AS j, l_quantity AS conf, l_extendedprice AS conf_t, 1 - l_discount AS conf_r, l_returnflag AS etype FROM lineitem)"
TASKS = "tasks AS (SELECT o_orderkey AS id, o_custkey AS employee, o_orderstatus AS status, o_orderdate AS created_at, o_totalprice AS size FROM orders)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, id, t, x, y, kind) of the event stream; (t, id) orders a run totally."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1e6D").alias("t"),
        F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), F.col("event_type").alias("kind"),
    )


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, z, r, g, b, conf, frame) of the vectors' first seven numbers."""
    at = lambda k: F.element_at("embedding", k + 1).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), *[at(k).alias(n) for k, n in enumerate(("x", "y", "z", "r", "g", "b", "conf"))], F.col("label").alias("frame"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, i, j, conf, conf_t, conf_r, etype) of the order lines."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("eid"), F.col("l_partkey").alias("i"), F.col("l_suppkey").alias("j"), F.col("l_quantity").alias("conf"),
        F.col("l_extendedprice").alias("conf_t"), (1 - F.col("l_discount")).alias("conf_r"), F.col("l_returnflag").alias("etype"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, employee, status, created_at, size) of the orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("employee"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("size"))
