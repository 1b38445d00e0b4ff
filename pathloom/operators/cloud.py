"""Point-cloud operators: predicates, profiles, sampling and rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import percentiles, with_position

AXES = ("x", "y", "z")
COLUMNS = (*AXES, "r", "g", "b", "conf")
LEVELS = (0.5, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0)
PERCENTS = (0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100)


def finite(*names: str) -> Column:
    """All of the columns are numbers, neither null nor NaN nor infinite."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) != float("inf"))
    return out


def filtered(points: DataFrame, min_conf: float, first: int | None = None, last: int | None = None, names=COLUMNS) -> DataFrame:
    """Finite points with enough confidence, in an inclusive frame range. The range
    and the confidence reach the Parquet scan where these are stored columns."""
    missing = set(names) - set(points.columns)
    if missing:
        raise ValueError(f"points lack {sorted(missing)}")
    if (first is not None or last is not None) and "frame" not in points.columns:
        raise ValueError("a frame range needs the column frame")
    keep = finite(*names) & (F.col("conf") >= min_conf)
    if first is not None:
        keep = keep & (F.col("frame") >= first)
    if last is not None:
        keep = keep & (F.col("frame") <= last)
    return points.filter(keep)


def sanitized(rows: DataFrame) -> DataFrame:
    """NaN and infinities of all floating-point columns become null."""
    kinds = dict(rows.dtypes)
    return rows.select(*[F.when(finite(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in rows.columns])


def confidence_profile(points: DataFrame, conf: str = "conf") -> DataFrame:
    """One row: linear percentiles p0..p100 and counts at or above each level."""
    one = points.agg(F.count(conf).alias("n"), *[F.count_if(F.col(conf) >= v).alias(f"ge_{str(v).replace('.', '_')}") for v in LEVELS])
    one = one.join(F.broadcast(percentiles(points, conf, [q / 100 for q in PERCENTS])))
    return one.select("n", *[F.element_at("p", i + 1).alias(f"p{q}") for i, q in enumerate(PERCENTS)], *[c for c in one.columns if c.startswith("ge_")])


def frame_stats(points: DataFrame) -> DataFrame:
    """One row about the frames: how many, first, last, and points in each."""
    per = points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count("frame").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("n").alias("min_points"), F.max("n").alias("max_points"), F.avg("n").alias("mean_points"))


def frame_histogram(points: DataFrame, ends: int = 20, most: int = 320) -> DataFrame:
    """Points for each frame; with over `most` frames only `ends` at either end."""
    per = points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    up, down = F.row_number().over(Window.orderBy("frame")), F.row_number().over(Window.orderBy(F.desc("frame")))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    return per.withColumns({"up": up, "down": down, "total": total}).filter((F.col("total") <= most) | (F.col("up") <= ends) | (F.col("down") <= ends)).select("frame", "n")


def frame_bounds(points: DataFrame, frames: list[int] | None = None) -> DataFrame:
    """For each frame: count and per axis mean, population deviation, min and max."""
    if frames is not None:
        points = points.filter(F.col("frame").isin(frames))
    return points.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), *[f(F.col(a)).alias(f"{k}_{a}") for a in AXES for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def top_confidence(points: DataFrame, k: int) -> DataFrame:
    """The k most confident points, ties by pid; a distributed top-k."""
    return points.orderBy(F.desc("conf"), "pid").limit(k)


def per_frame_uniform(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """ceil(most / frames) points of every frame, in the order of a hash of pid."""
    frames = points.select("frame").distinct().agg(F.ceil(F.lit(most) / F.count(F.lit(1))).alias("quota"))
    rank = F.row_number().over(Window.partitionBy("frame").orderBy(hash_order("pid", seed), "pid"))
    return points.withColumn("rank", rank).join(F.broadcast(frames), F.col("rank") <= F.col("quota")).drop("rank", "quota")


def hash_order(key: str, seed: int) -> Column:
    """A fixed pseudo-random order that SQL engines share: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def random_sample(points: DataFrame, most: int, seed: int = 42) -> DataFrame:
    """`most` points, the first in hash order."""
    return points.orderBy(hash_order("pid", seed), "pid").limit(most)


def voxel_sample(points: DataFrame, grid: int) -> DataFrame:
    """The smallest pid of every cell of a grid over the bounding box."""
    box = points.agg(*[f(F.col(a)).alias(f"{n}_{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    cell = lambda a: F.least(F.lit(grid - 1), F.floor((F.col(a) - F.col(f"lo_{a}")) / F.greatest(F.col(f"hi_{a}") - F.col(f"lo_{a}"), F.lit(1e-9)) * grid)).alias(f"c{a}")
    boxed = points.join(F.broadcast(box)).select(*points.columns, *[cell(a) for a in AXES])
    return boxed.groupBy("cx", "cy", "cz").agg(F.min_by(F.struct(*points.columns), "pid").alias("point")).select("point.*")


def stride_sample(points: DataFrame, k: int, order: str = "pid") -> DataFrame:
    """k rows at positions floor(i * n / k) of the given order."""
    n = points.agg(F.count(F.lit(1)).alias("n"))
    placed = with_position(points, order, name="at").join(F.broadcast(n))
    first = F.ceil(F.col("at") * F.lit(k) / F.col("n"))
    return placed.filter((F.col("n") <= k) | (F.floor(first * F.col("n") / k) == F.col("at"))).drop("at", "n")


def colour(points: DataFrame) -> DataFrame:
    """Channels as numbers in [0, 1]; any channel above 1 means bytes."""
    scale = F.when(F.greatest("r", "g", "b") > 1, 255.0).otherwise(1.0)
    return points.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c) / scale)) for c in ("r", "g", "b")})


def _percentile_row(points: DataFrame, wanted: dict[str, tuple[str, list[float]]]) -> DataFrame:
    """One row: for each name the percentiles of its column."""
    rows = [percentiles(points, column, shares, name) for name, (column, shares) in wanted.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)


def display(points: DataFrame) -> DataFrame:
    """Centred at the medians, scaled to 18 / p95 of the radius, axes (x, z, -y).
    The percentile is the nearest rank below."""
    centre = _percentile_row(points, {f"m{a}": (a, [0.5]) for a in AXES}).select(*[F.col(f"m{a}")[0].alias(f"m{a}") for a in AXES])
    moved = points.join(F.broadcast(centre)).select(*points.columns, *[(F.col(a) - F.col(f"m{a}")).alias(f"d{a}") for a in AXES])
    moved = moved.withColumn("radius", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))
    n = points.agg(F.count(F.lit(1)).alias("n"))
    ranked = with_position(moved.select("radius", "pid"), "radius", "pid").join(F.broadcast(n))
    p95 = ranked.filter(F.col("pos") == F.floor((F.col("n") - 1) * 0.95)).select((18 / F.greatest("radius", F.lit(1e-9))).alias("scale"))
    return moved.join(F.broadcast(p95)).select("pid", (F.col("dx") * F.col("scale")).alias("px"), (F.col("dz") * F.col("scale")).alias("py"), (-F.col("dy") * F.col("scale")).alias("pz"))


def display_clean(points: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Points inside the percentile box of every axis."""
    box = _percentile_row(points, {f"q{a}": (a, [low, high]) for a in AXES})
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"q{a}")[0], F.col(f"q{a}")[1])
    return points.join(F.broadcast(box), inside, "inner").select(*points.columns)


def raster(points: DataFrame, width: int, height: int) -> DataFrame:
    """Counts of points in pixels of the box from p1 to p99 of x and y, clamped."""
    box = _percentile_row(points, {f"q{a}": (a, [0.01, 0.99]) for a in ("x", "y")})
    pixel = lambda a, size: F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor((F.col(a) - F.col(f"q{a}")[0]) / F.greatest(F.col(f"q{a}")[1] - F.col(f"q{a}")[0], F.lit(1e-9)) * (size - 1))))
    return points.join(F.broadcast(box)).select(pixel("x", width).alias("px"), pixel("y", height).alias("py")).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))


def unprojected(depth: DataFrame, cameras: DataFrame, min_conf: float = 0.0, min_depth: float = 0.001) -> DataFrame:
    """World points of depth rasters.

    depth: run, frame, w, h, depth array, conf array or null; cameras: run, frame, r00..r22,
    tx, ty, tz and fx, fy, cx, cy or null (then f = 1.2 * max(w, h), centre of the raster).
    A missing confidence is 2.0. Points need finite depth above min_depth and
    confidence above min_conf.
    """
    cells = depth.select("run", "frame", "w", "h", "conf", F.posexplode("depth").alias("pos", "d"))
    cells = cells.withColumns({"u": F.pmod("pos", "w"), "v": F.floor(F.col("pos") / F.col("w")), "c": F.coalesce(F.try_element_at("conf", F.col("pos") + 1), F.lit(2.0))})
    cells = cells.filter(finite("d") & (F.col("d") > min_depth) & (F.col("c") > min_conf))
    f = 1.2 * F.greatest("w", "h")
    met = cells.join(cameras, ["run", "frame"])
    local = met.withColumns({"lx": (F.col("u") - F.coalesce("cx", F.col("w") / 2)) * F.col("d") / F.coalesce("fx", f), "ly": (F.col("v") - F.coalesce("cy", F.col("h") / 2)) * F.col("d") / F.coalesce("fy", f)})
    world = [(F.col(f"r{k}0") * F.col("lx") + F.col(f"r{k}1") * F.col("ly") + F.col(f"r{k}2") * F.col("d") + F.col(f"t{a}")).alias(a) for k, a in enumerate(AXES)]
    return local.select("run", "frame", "pos", *world, F.col("c").alias("conf"))
