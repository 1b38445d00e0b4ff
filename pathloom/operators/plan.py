"""Floor-plan grids: occupancy lookups, sampled lines and similarity fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occupancy(pixels: DataFrame, cell: int, share: float = 0.6) -> DataFrame:
    """Grid cells from (px, py, luma 0..1): occupied where the mean is below `share`."""
    return pixels.groupBy(F.floor(F.col("px") / cell).alias("cx"), F.floor(F.col("py") / cell).alias("cy")).agg((F.avg("luma") < share).alias("occupied"), F.count(F.lit(1)).alias("n"))


def looked_up(points: DataFrame, cells: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """points with their cell's occupancy; a place outside the plan is occupied, and `outside`."""
    at = points.withColumns({"cx": F.floor(F.col(x) / size), "cy": F.floor(F.col(y) / size)})
    met = at.join(cells.select("cx", "cy", "occupied"), ["cx", "cy"], "left")
    return met.withColumns({"outside": F.col("occupied").isNull(), "occupied": F.coalesce("occupied", F.lit(True))})


def line_samples(df: DataFrame, step: float, run: str, order: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Even samples (seg, k, x, y) along the segments of each run, ends included."""
    w = Window.partitionBy(run).orderBy(*order)
    seg = df.select(run, F.row_number().over(w).alias("seg"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1")).filter("x1 is not null")
    parts = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / step)).cast("long")
    rows = seg.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), "parts")))
    share = F.col("k") / F.col("parts")
    return rows.select(run, "seg", "k", (F.col("x0") + (F.col("x1") - F.col("x0")) * share).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * share).alias("y"))


def line_report(samples: DataFrame, cells: DataFrame, size: float, run: str) -> DataFrame:
    """Per run: samples, shares in occupied cells and outside the plan, distinct cells, and the longest row of occupied ones in sequence."""
    hit = looked_up(samples, cells, size)
    w = Window.partitionBy(run).orderBy("seg", "k")
    rows = hit.withColumn("_n", F.row_number().over(w))
    total = rows.groupBy(run).agg(F.count(F.lit(1)).alias("samples"), F.avg(F.col("occupied").cast("double")).alias("occupied_ratio"), F.avg(F.col("outside").cast("double")).alias("outside_ratio"), F.count_distinct("cx", "cy").alias("cells"))
    runs = rows.filter("occupied").withColumn("_g", F.col("_n") - F.row_number().over(Window.partitionBy(run).orderBy("_n"))).groupBy(run, "_g").agg(F.count(F.lit(1)).alias("len")).groupBy(run).agg(F.max("len").alias("longest_hit"))
    return total.join(runs, run, "left").withColumn("longest_hit", F.coalesce("longest_hit", F.lit(0)))


def fitted_similarity(pairs: DataFrame, by: str) -> DataFrame:
    """Least-squares rotation (degrees), scale and shift from (x, y) to (u, v) by group,
    in closed form from sums; null where the source has no extent."""
    m = pairs.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias("m" + c) for c in "xyuv"], F.avg(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("dot"), F.avg(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("cross"), F.avg(F.col("x") ** 2 + F.col("y") ** 2).alias("sq"))
    dot, cross = F.col("dot") - F.col("mx") * F.col("mu") - F.col("my") * F.col("mv"), F.col("cross") - F.col("mx") * F.col("mv") + F.col("my") * F.col("mu")
    var = F.nullif(F.round(F.col("sq") - F.col("mx") ** 2 - F.col("my") ** 2, 12), F.lit(0.0))
    a, b = dot / var, cross / var
    return m.select(by, "n", F.hypot(a, b).alias("scale"), F.degrees(F.atan2(b, a)).alias("angle"), (F.col("mu") - a * F.col("mx") + b * F.col("my")).alias("dx"), (F.col("mv") - b * F.col("mx") - a * F.col("my")).alias("dy"))


def plan_points(df: DataFrame, run: str, order: list[str], anchor: tuple[float, float], heading: float, scale: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each run moved to the anchor and turned so that the chord over its first tenth
    (2 to 20 rows) points in `heading`."""
    w = Window.partitionBy(run).orderBy(*order)
    rows = df.withColumns({"_k": F.row_number().over(w), "_n": F.count(F.lit(1)).over(Window.partitionBy(run))})
    end = F.least(F.col("_n"), F.greatest(F.lit(2), F.least(F.lit(20), F.ceil(F.col("_n") / 10))))
    pick = lambda c, at: F.max(F.when(F.col("_k") == at, F.col(c))).over(Window.partitionBy(run))
    rows = rows.withColumn("_e", end).withColumns({"_x0": pick(x, F.lit(1)), "_y0": pick(y, F.lit(1)), "_x1": pick(x, F.col("_e")), "_y1": pick(y, F.col("_e"))})
    turn = F.radians(F.lit(heading)) - F.atan2(F.col("_y1") - F.col("_y0"), F.col("_x1") - F.col("_x0"))
    dx, dy = F.col(x) - F.col("_x0"), F.col(y) - F.col("_y0")
    out = rows.withColumn("_a", turn)
    return out.select(*df.columns, (anchor[0] + scale * (F.cos("_a") * dx - F.sin("_a") * dy)).alias("px"), (anchor[1] + scale * (F.sin("_a") * dx + F.cos("_a") * dy)).alias("py"))


def direction_bins(lines: DataFrame, length: Column, angle: Column, bins: int = 36) -> DataFrame:
    """Length of lines by direction modulo 180 degrees, and each bin's share."""
    b = F.least(F.lit(bins - 1), F.floor(F.pmod(angle, F.lit(180.0)) / (180.0 / bins))).alias("bin")
    per = lines.groupBy(b).agg(F.sum(length).alias("length"))
    return per.join(F.broadcast(per.agg(F.sum("length").alias("total")))).select("bin", "length", (F.col("length") / F.col("total")).alias("share"))
