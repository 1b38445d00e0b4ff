"""Beam search over scale and yaw of routes on floor plans.

Hypotheses lie on a lattice of scale steps and yaw steps. The frontier is a table
of a few rows per run; a level joins its hypotheses to the run's samples and these
to the plan's cells, scores by aggregates, and keeps the best of each run. The first
level takes every `strides[0]`-th point of the lattice, each later one the
neighbours at a smaller stride of what was kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored

#: Weights of samples on occupied cells, outside the plan, near walls, of the speed's prior and of 5 degrees of yaw.
COLLISION, OUTSIDE, TIGHT, SPEED, YAW = 34.0, 60.0, 0.35, 1.25, 0.08
ROOM = 0.45
#: Runs on one map that one task scores.
RUNS_A_BLOCK = 64
#: Spark's own setting: without it tables dealt by some of a join's keys are dealt again by all of them.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


@contextmanager
def _met_by_block(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside keep the partitioning by map and block."""
    before = spark.conf.get(ALL_KEYS)
    spark.conf.set(ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(ALL_KEYS, before)


def scored(samples: DataFrame, cells: DataFrame, hyps: DataFrame, ratio: float, step_degrees: float, size: float, metres: float) -> DataFrame:
    """Hypotheses (map, block, run, si, yi) of samples (map, block, run, dx, dy, sx, sy, turn, base, pace) with score and its parts.

    Samples, hypotheses and cells of a block meet in one task and stream through it, so
    the samples of all hypotheses are never shuffled; `searched` bounds a block's runs.

    A sample lies at (sx, sy) + base * ratio ** si * R(turn + yi steps) (dx, dy).
    `pace` is the route's speed at scale base over the usual walking speed, null if
    unknown; the speed costs the square of its ratio's logarithm.
    """
    scale = F.col("base") * F.pow(F.lit(ratio), F.col("si"))
    angle = F.col("turn") + F.col("yi") * math.radians(step_degrees)
    x = F.col("sx") + scale * (F.cos(angle) * F.col("dx") - F.sin(angle) * F.col("dy"))
    y = F.col("sy") + scale * (F.sin(angle) * F.col("dx") + F.cos(angle) * F.col("dy"))
    at = hyps.repartition("map", "block").join(samples.repartition("map", "block").hint("shuffle_hash"), ["map", "block", "run"]).select("map", "block", "run", "si", "yi", "pace", F.floor(x / size).alias("cx"), F.floor(y / size).alias("cy"))
    met = at.join(cells.repartition("map", "block").hint("shuffle_hash"), ["map", "block", "cx", "cy"], "left")
    share = lambda c: F.avg(c.cast("double"))
    per = met.groupBy("map", "block", "run", "si", "yi").agg(
        share(F.coalesce("occupied", F.lit(True))).alias("collision"), share(F.col("occupied").isNull()).alias("outside"),
        F.avg(F.exp(-F.coalesce("clearance", F.lit(0.0)) * size * metres / ROOM)).alias("tight"), F.first("pace", True).alias("pace"),
    )
    speed = F.coalesce(F.log(F.col("pace") * F.pow(F.lit(ratio), F.col("si"))) ** 2, F.lit(0.0))
    score = COLLISION * F.col("collision") + OUTSIDE * F.col("outside") + TIGHT * F.col("tight") + SPEED * speed + YAW * F.abs("yi") * step_degrees / 5
    return per.select("map", "block", "run", "si", "yi", F.round(score, 9).alias("score"), "collision", "outside")


def best_of(found: DataFrame, width: int) -> DataFrame:
    """The `width` best hypotheses of each run (run, place, score, si, yi, collision, outside); ties go to the smaller yaw step, then scale step.

    A run has a bounded number of hypotheses, so the list of a group is bounded.
    """
    one = F.struct("score", F.abs("yi").alias("turned"), "yi", "si", "collision", "outside")
    top = found.groupBy("map", "block", "run").agg(F.slice(F.array_sort(F.collect_list(one)), 1, width).alias("top"))
    return top.select("map", "block", "run", F.posexplode("top").alias("place", "h")).select("map", "block", "run", "place", "h.score", "h.si", "h.yi", "h.collision", "h.outside")


def lattice(reach: int, stride: int) -> Column:
    return F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k % stride == 0])


def searched(samples: DataFrame, cells: DataFrame, width: int = 6, strides: tuple[int, ...] = (4, 2, 1), scales: int = 8, yaws: int = 12, ratio: float = 1.08, step_degrees: float = 5.0, size: float = 1.0, metres: float = 1.0) -> DataFrame:
    """The frontier after the last level: (run, place, score, scale_step, yaw_step, collision, outside, margin).

    The lattice has scale steps within `scales` and yaw steps within `yaws` of
    0. `margin` is the score of the next place less this one's, null at the
    last. As wide as the lattice, the search is exhaustive. Cells outside the
    plan count as occupied and as outside; a run without samples has no rows. A run lies on one map.
    """
    samples = stored(samples, "samples")
    runs = samples.select("map", "run").distinct()
    many = runs.groupBy("map").agg(F.ceil(F.count(F.lit(1)) / RUNS_A_BLOCK).alias("blocks"))
    runs = stored(runs.join(many, "map").select("map", "run", F.pmod(F.xxhash64("run"), F.col("blocks")).alias("block")), "runs")
    samples = stored(samples.join(runs, ["map", "run"]), "samples")
    cells = stored(cells.join(runs.select("map", "block").distinct(), "map").select("map", "block", "cx", "cy", "occupied", "clearance"), "cells")
    level = lambda hyps: stored(best_of(scored(samples, cells, hyps, ratio, step_degrees, size, metres), width), "frontier")
    hyps = runs.select("map", "block", "run", F.explode(lattice(scales, strides[0])).alias("si")).select("map", "block", "run", "si", F.explode(lattice(yaws, strides[0])).alias("yi"))
    with _met_by_block(samples.sparkSession):
        kept = level(hyps)
    for stride in strides[1:]:
        around = F.explode(F.array(*[F.struct(F.lit(a).alias("ds"), F.lit(b).alias("dy")) for a in (-stride, 0, stride) for b in (-stride, 0, stride)])).alias("o")
        hyps = kept.select("map", "block", "run", "si", "yi", around).select("map", "block", "run", (F.col("si") + F.col("o.ds")).alias("si"), (F.col("yi") + F.col("o.dy")).alias("yi")).distinct()
        hyps = hyps.filter((F.abs("si") <= scales) & (F.abs("yi") <= yaws))
        with _met_by_block(samples.sparkSession):
            before, kept = kept, level(hyps)
        drop_stored(before)
    after = kept.select("run", (F.col("place") - 1).alias("place"), F.col("score").alias("then"))
    return kept.join(after, ["run", "place"], "left").select("run", "place", "score", F.col("si").alias("scale_step"), F.col("yi").alias("yaw_step"), "collision", "outside", (F.col("then") - F.col("score")).alias("margin"))
