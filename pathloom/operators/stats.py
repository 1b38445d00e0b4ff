"""Robust statistics, data quality and calibration helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .graph import component_summary
from .ranking import percentiles


def five_numbers(df: DataFrame, value: str, by: str) -> DataFrame:
    """min, p10, p50, p90, max with six decimals; null where a group has no value."""
    p = F.percentile(value, F.array(*[F.lit(q) for q in (0.0, 0.1, 0.5, 0.9, 1.0)])).alias("p")
    return df.groupBy(by).agg(p, F.count(value).alias("n")).select(by, "n", *[F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate(("min", "p10", "p50", "p90", "max"))])


def weighted_percentile(df: DataFrame, value: str, weight: str, by: str, p: float, tie: str) -> DataFrame:
    """First value whose running weight reaches the share p of its group's weight."""
    w = Window.partitionBy(by).orderBy(value, tie)
    rows = df.withColumns({"_run": F.sum(weight).over(w), "_all": F.sum(weight).over(Window.partitionBy(by))})
    return rows.filter(F.col("_run") >= p * F.col("_all")).groupBy(by).agg(F.min(value).alias("value"))


def clipped_objective(df: DataFrame, residual: str, weight: str, by: str, most: float) -> DataFrame:
    """Weighted mean of squared residuals cut at `most`, and share of weight within it."""
    r, w = F.col(residual), F.col(weight)
    return df.groupBy(by).agg((F.sum(w * F.least(r * r, F.lit(most * most))) / F.sum(w)).alias("objective"), (F.sum(F.when(F.abs(r) <= most, w).otherwise(0.0)) / F.sum(w)).alias("inliers"))


def robust_weights(df: DataFrame, value: str, by: str) -> DataFrame:
    """Values filled with their group's median and scaled from p10..p90 to 0..1, 0.5 where these coincide."""
    p = df.groupBy(by).agg(F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("_p"))
    rows = df.join(p, by)
    filled, low, high = F.coalesce(F.col(value), F.col("_p")[1]), F.col("_p")[0], F.col("_p")[2]
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (filled - low) / F.nullif(high - low, F.lit(0.0))))
    return rows.withColumn("weight", F.coalesce(unit, F.lit(0.5))).drop("_p")


def median_ratio(df: DataFrame, value: str) -> DataFrame:
    """Values over the median of the positive ones, cut to [0.1, 10]."""
    centre = percentiles(df.filter(F.col(value) > 0), value, [0.5]).select(F.col("p")[0].alias("_m"))
    return df.join(F.broadcast(centre)).withColumn("weight", F.greatest(F.lit(0.1), F.least(F.lit(10.0), F.col(value) / F.col("_m")))).drop("_m")


def mad_outliers(df: DataFrame, value: str, by: str, limit: float = 3.5) -> DataFrame:
    """Rows farther from their group's median than `limit` scaled median absolute deviations."""
    centre = df.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("_m"))
    far = df.join(centre, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    spread = far.groupBy(by).agg(F.percentile("_d", F.lit(0.5)).alias("_mad"))
    return far.join(spread, by).filter(F.col("_d") > limit * 1.4826 * F.greatest("_mad", F.lit(1e-12))).drop("_m", "_d", "_mad")


def edge_report(edges: DataFrame, frames: int) -> DataFrame:
    """One row about an edge list: conditional counts, coverage and a readiness gate."""
    bad = (F.col("i") < 0) | (F.col("j") < 0)
    count = lambda c: F.count_if(c)
    got = edges.agg(
        F.count(F.lit(1)).alias("edges"), count(bad).alias("negative"), count(F.col("i") == F.col("j")).alias("self"), count((F.col("i") >= frames) | (F.col("j") >= frames)).alias("out_of_range"),
        count(F.col("conf_t").isNotNull() & F.col("conf_r").isNotNull()).alias("split_confidence"), *[count(F.col("etype") == k).alias(f"type_{k.lower()}") for k in ("A", "N", "R")],
    ).join(F.broadcast(percentiles(edges, "conf", [0.5]).select(F.col("p")[0].alias("median_conf"))))
    ready = (F.col("edges") > 0) & (F.col("negative") == 0) & (F.col("self") * 100 <= F.col("edges")) & (F.col("split_confidence") == F.col("edges"))
    return got.withColumn("ready", ready)


#: Range of a quaternion's length, and the shares from which an edge list is ready.
QUATERNION, POSED, SPLIT, JOINED = (0.95, 1.05), 0.95, 0.8, 0.8


def readiness(edges: DataFrame, frames: int, contract: bool = True) -> DataFrame:
    """One row that says whether an edge list can be optimised, and why not.

    edges (i, j, conf, conf_t, conf_r, etype, pose: shift, quaternion and two more,
    null or broken where there is none) over frames 0 to frames - 1. Counts of
    negative, self and outside edges exclude those counted before; all else is
    about the edges that are left. `connected` is the largest component's share
    of the frames. Ready: the contract holds, 95 % have a pose and 80 % both
    confidences, no confidence is missing, no quaternion's length is off, and
    80 % of the frames hang together.
    """
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    finite = (F.size("pose") == 9) & F.forall("pose", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sure = lambda c: F.coalesce(real(c) & (F.col(c) > 0), F.lit(False))
    size = lambda a, n: F.sqrt(F.aggregate(F.slice("pose", a, n), F.lit(0.0), lambda t, x: t + x * x))
    negative, self_, outside = (F.col("i") < 0) | (F.col("j") < 0), F.col("i") == F.col("j"), (F.col("i") >= frames) | (F.col("j") >= frames)
    rows = edges.select(
        "i", "j", "etype", negative.alias("negative"), (~negative & self_).alias("self"), (~negative & ~self_ & outside).alias("outside"), F.coalesce(finite, F.lit(False)).alias("posed"),
        sure("conf").alias("sure"), (sure("conf_t") & sure("conf_r")).alias("split"), size(1, 3).alias("shift"), size(4, 4).alias("turn"),
    ).withColumn("good", ~(F.col("negative") | F.col("self") | F.col("outside")))
    rows = stored(rows, "edges")
    good, posed = F.col("good"), F.col("good") & F.col("posed")
    share = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count_if(good), F.lit(0)), F.lit(0.0))
    got = rows.agg(
        F.count(F.lit(1)).alias("edges"), F.count_if(good).alias("valid"), *[F.count_if(c).alias(c) for c in ("negative", "self", "outside")], F.count_if(good & ~F.col("posed")).alias("without_pose"),
        share(posed).alias("pose_coverage"), share(good & F.col("split")).alias("split_coverage"), F.count_if(good & ~F.col("sure")).alias("without_confidence"), F.count_if(posed & ~F.col("turn").between(*QUATERNION)).alias("quaternion_outliers"),
        *[F.count_if(F.col("etype") == k).alias(f"type_{k.lower()}") for k in ("A", "N", "R")],
    )
    valid = rows.filter("good")
    for name, value, kept in (("shift", F.col("shift"), valid.filter("posed")), ("gap", F.abs(F.col("j") - F.col("i")), valid)):
        p = percentiles(kept, value, [0.5, 0.95]).select(F.col("p")[0].alias(f"median_{name}"), F.col("p")[1].alias(f"p95_{name}"))
        got = got.join(F.broadcast(p))
    parts = component_summary(valid.select("i", "j"), edges.sparkSession.range(frames).withColumnRenamed("id", "node"))
    got = got.join(F.broadcast(parts.select("components", F.col("coverage").alias("connected"))))
    ready = F.lit(contract) & (F.col("valid") > 0) & (F.col("pose_coverage") >= POSED) & (F.col("split_coverage") >= SPLIT) & (F.col("without_confidence") == 0) & (F.col("quaternion_outliers") == 0) & (F.col("connected") >= JOINED)
    return got.withColumn("ready", ready)


def ratios(df: DataFrame, by: str, counters: dict[str, Column]) -> DataFrame:
    """Share of rows for each named condition, by group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[(F.count_if(c) / F.count(F.lit(1))).alias(name) for name, c in counters.items()])


def dominant(df: DataFrame, by: str, kind: str) -> DataFrame:
    """Most frequent kind of each group, the smallest on a tie."""
    per = df.groupBy(by, kind).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(by).agg(F.max(F.struct("n")).alias("m"), F.min_by(kind, F.struct(-F.col("n"), F.col(kind))).alias("dominant")).select(by, "dominant", F.col("m.n").alias("n"))


def reliability(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """Counts, mean score and share of positive labels by equal-width bins of [0, 1]."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).alias("bin")
    return df.groupBy(b).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
