"""Sinks: candidates beside raw data, JSON documents, histories and logs.

Spark's commit protocol makes each write atomic: readers see all files of a
finished job or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import with_position


def write_candidate(df: DataFrame, root: str, candidate: str) -> str:
    """A candidate's table in its own folder; raw data are never overwritten."""
    if candidate in ("", "raw") or "/" in candidate:
        raise ValueError(f"no name for a candidate: {candidate!r}")
    path = f"{root}/candidate={candidate}"
    df.write.mode("overwrite").parquet(path)
    return path


def write_documents(df: DataFrame, path: str, document: Column, key: str) -> None:
    """One JSON line for each key, the whole document in it."""
    df.select(F.to_json(F.struct(F.col(key), document.alias("document"))).alias("value")).write.mode("overwrite").text(path)


def append_status(df: DataFrame, path: str) -> None:
    """Status rows appended as JSON lines, progress kept within 0 and 1."""
    df.withColumn("progress", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "progress"))).write.mode("append").json(path)


def newest(df: DataFrame, at: str, tie: str, most: int = 100) -> DataFrame:
    """The history that is kept: the newest rows, `most` of them."""
    return df.orderBy(F.desc(at), F.desc(tie)).limit(most)


def current_only(df: DataFrame, by: str, run: str, started: str) -> DataFrame:
    """Rows of each key's latest run; older runs are out of date, and can't come back."""
    latest = df.groupBy(by).agg(F.max_by(run, F.struct(started, run)).alias(run))
    return df.join(latest, [by, run], "left_semi")


def nested_analysis(points: DataFrame, turns: DataFrame, run: str, pivot: int = 50) -> DataFrame:
    """(run, document) with trajectory_data, turned so that its pivot row lies ahead, and turn_analysis.

    points: run, k, x, y. turns: run, k, angle. The rows of a run make its document.
    """
    w = Window.partitionBy(run).orderBy("k")
    first = F.first(F.struct("x", "y")).over(w)
    count = F.count(F.lit(1)).over(Window.partitionBy(run))
    rows = points.withColumns({"first": first, "place": F.row_number().over(w) - 1, "last": count - 1})
    ahead = F.max(F.when(F.col("place") == F.least(F.lit(pivot), "last"), F.struct("x", "y"))).over(Window.partitionBy(run))
    rows = rows.withColumn("ahead", ahead)
    turn = F.atan2(F.col("ahead.y") - F.col("first.y"), F.col("ahead.x") - F.col("first.x"))
    dx, dy = F.col("x") - F.col("first.x"), F.col("y") - F.col("first.y")
    rows = rows.withColumn("turn", turn).select(run, "k", (F.cos("turn") * dx + F.sin("turn") * dy).alias("x"), (F.cos("turn") * dy - F.sin("turn") * dx).alias("y"))
    path = rows.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("k", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")))).alias("trajectory_data"))
    bends = turns.groupBy(run).agg(F.sort_array(F.collect_list(F.struct("k", F.round("angle", 1).alias("angle")))).alias("turn_analysis"))
    return path.join(bends, run, "left").select(run, F.to_json(F.struct("trajectory_data", F.coalesce("turn_analysis", F.array()).alias("turn_analysis"))).alias("document"))


def export_cloud(points: DataFrame, root: str, least: float, stride: int, most: int) -> DataFrame:
    """Write a thinned cloud and a report about it under root; returns the cloud read back.

    points (frame, pid, x, y, z, conf): those of `least` confidence, in order of
    frame and pid, every `stride`-th, and of these every k-th so that at most
    `most` remain. The report is one JSON line: rows before and after, bounds,
    mean confidence and the step taken.
    """
    kept = with_position(points.filter(F.col("conf") >= least), "frame", "pid")
    thin = kept.filter(F.col("pos") % stride == 0)
    step = max(1, -(-thin.count() // most))
    thin.filter(F.expr(f"pos div {stride}") % step == 0).drop("pos").write.mode("overwrite").parquet(f"{root}/cloud")
    back = points.sparkSession.read.schema(points.schema).parquet(f"{root}/cloud")
    bounds = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    after = back.agg(F.count(F.lit(1)).alias("after"), F.avg("conf").alias("mean_conf"), *bounds)
    report = points.agg(F.count(F.lit(1)).alias("before")).join(F.broadcast(after)).withColumn("step", F.lit(stride * step))
    report.write.mode("overwrite").json(f"{root}/report")
    return back
