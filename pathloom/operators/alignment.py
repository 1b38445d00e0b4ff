"""Rotations, planes and similarities: alignment of observed paths."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType

from ..sources.shared import drop_stored, stored
from .joins import ROWS_A_TASK, as_of
from .plan import fitted_similarity
from .ranking import grouped_percentiles, with_position


NUMBERS = ArrayType(DoubleType())


def nearest_rotation(matrices: np.ndarray) -> np.ndarray:
    """The rotations nearest to a stack of 3 x 3 matrices; the weakest direction flips where a mirror is nearer."""
    u, _, v = np.linalg.svd(matrices)
    flip = np.ones((len(matrices), 3))
    flip[:, 2] = np.sign(np.linalg.det(u @ v))
    return (u * flip[:, None, :]) @ v


@F.arrow_udf(NUMBERS)
def projected_rotation(matrix: pa.Array) -> pa.Array:
    """Nine numbers, row by row, as the nearest rotation; null where one is missing or not finite."""
    rows = matrix.to_pylist()
    good = [k for k, r in enumerate(rows) if r is not None and len(r) == 9 and all(x is not None and math.isfinite(x) for x in r)]
    out: list = [None] * len(rows)
    if good:
        for k, r in zip(good, nearest_rotation(np.array([rows[k] for k in good], float).reshape(-1, 3, 3)), strict=True):
            out[k] = r.reshape(-1).tolist()
    return pa.array(out, pa.list_(pa.float64()))


@F.arrow_udf(NUMBERS)
def principal_axes(cov: pa.Array) -> pa.Array:
    """Per covariance (xx, xy, xz, yy, yz, zz): two main axes, each with a positive largest entry, and the share of variance in their plane."""
    c = np.array(cov.to_pylist(), float).reshape(-1, 6)
    values, vectors = np.linalg.eigh(c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    axes = vectors[:, :, ::-1][:, :, :2].transpose(0, 2, 1)
    main = np.take_along_axis(axes, np.abs(axes).argmax(axis=2)[..., None], axis=2)
    axes = axes * np.where(main < 0, -1.0, 1.0)
    total = values.sum(axis=1)
    share = np.where(total > 1e-18, (values[:, 1] + values[:, 2]) / np.where(total > 1e-18, total, 1), 1.0)
    return pa.array([[*a.reshape(-1), s] for a, s in zip(axes, share, strict=True)], pa.list_(pa.float64()))


def _median(df: DataFrame, by: str, value, name: str) -> DataFrame:
    return grouped_percentiles(df, by, value, [0.5]).select(by, F.col("p")[0].alias(name))


def motion_plane(df: DataFrame, run: str, keep: list[str]) -> DataFrame:
    """Positions (x, y, z) of each run in the plane of their two main axes around the median: u, v, and the plane's share.

    The covariance is an aggregate; only its 3 x 3 decomposition is Python, one row for each run.
    """
    centre = reduce(lambda a, b: a.join(b, run), [_median(df, run, F.col(c), f"med_{c}") for c in "xyz"])
    moved = df.join(centre, run).select(run, *keep, *[(F.col(c) - F.col(f"med_{c}")).alias(f"d{c}") for c in "xyz"])
    cov = moved.groupBy(run).agg(F.array(*[F.avg(F.col(f"d{a}") * F.col(f"d{b}")) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("cov"))
    axes = cov.select(run, principal_axes("cov").alias("a"))
    on = lambda k: sum((F.col("a")[3 * k + i] * F.col(f"d{c}") for i, c in ((1, "y"), (2, "z"))), F.col("a")[3 * k] * F.col("dx"))
    return moved.join(axes, run).select(run, *keep, on(0).alias("u"), on(1).alias("v"), F.col("a")[6].alias("plane_share"))


def floor_basis(normals: DataFrame, first_heading: DataFrame, run: str) -> DataFrame:
    """Axes of a floor (run, xx, xy, xz, yx, yy, yz, nx, ny, nz).

    normals (run, priority, nx, ny, nz, support, least): of those with enough
    support and length the first in order is taken, else -Y. X is the run's
    first heading (hx, hy, hz) laid into the floor, Y is n x X.
    """
    usable = F.when((F.col("support") >= F.col("least")) & (F.sqrt(F.expr("nx * nx + ny * ny + nz * nz")) > 1e-9), F.struct("priority", "nx", "ny", "nz"))
    best = normals.groupBy(run).agg(F.min(usable).alias("n"))
    rows = best.join(first_heading, run).select(run, F.coalesce("n.nx", F.lit(0.0)).alias("nx"), F.coalesce("n.ny", F.lit(-1.0)).alias("ny"), F.coalesce("n.nz", F.lit(0.0)).alias("nz"), "hx", "hy", "hz")
    unit = lambda d, p: d.withColumn("len", F.sqrt(F.expr(f"{p}x * {p}x + {p}y * {p}y + {p}z * {p}z"))).withColumns({f"{p}{a}": F.col(f"{p}{a}") / F.greatest("len", F.lit(1e-12)) for a in "xyz"}).drop("len")
    rows = unit(rows, "n").withColumn("on", F.expr("hx * nx + hy * ny + hz * nz"))
    rows = unit(rows.withColumns({f"h{a}": F.col(f"h{a}") - F.col("on") * F.col(f"n{a}") for a in "xyz"}), "h")
    cross = {"yx": "ny * hz - nz * hy", "yy": "nz * hx - nx * hz", "yz": "nx * hy - ny * hx"}
    return rows.select(run, *[F.col(f"h{a}").alias(f"x{a}") for a in "xyz"], *[F.expr(e).alias(k) for k, e in cross.items()], "nx", "ny", "nz")


def robust_similarity(pairs: DataFrame, by: str, rounds: int = 5) -> DataFrame:
    """Rotation (degrees), scale and shift from (x, y) to (u, v) by group, less swayed by outliers.

    Every round is a weighted closed form from sums; pairs beyond median + 2.5
    scaled MADs weigh less. Repeated pairs count as often as they come; groups
    without extent have nulls.
    """
    rows = stored(pairs.select(by, "x", "y", "u", "v").withColumn("w", F.lit(1.0)), "pairs")
    for k in range(rounds):
        fit = _weighted_fit(rows, by)
        if k == rounds - 1:
            out = stored(fit, "fit")
            drop_stored(rows)
            return out
        turned = F.radians("angle")
        px = F.col("scale") * (F.cos(turned) * F.col("x") - F.sin(turned) * F.col("y")) + F.col("dx")
        py = F.col("scale") * (F.sin(turned) * F.col("x") + F.cos(turned) * F.col("y")) + F.col("dy")
        off = stored(rows.join(fit, by).select(by, "x", "y", "u", "v", F.hypot(px - F.col("u"), py - F.col("v")).alias("off")), "off")
        off = off.join(_median(off, by, F.col("off"), "med"), by)
        mad = _median(off, by, F.abs(F.col("off") - F.col("med")), "mad")
        limit = F.greatest(F.col("med") + 2.5 * 1.4826 * F.col("mad"), F.lit(1e-6))
        new = stored(off.join(mad, by).select(by, "x", "y", "u", "v", F.least(F.lit(1.0), limit / F.greatest("off", F.lit(1e-12))).alias("w")), "pairs")
        drop_stored(rows)
        rows = new
    return fitted_similarity(rows, by)


def _weighted_fit(rows: DataFrame, by: str) -> DataFrame:
    w = F.col("w")
    mean = rows.groupBy(by).agg(*[(F.sum(w * F.col(c)) / F.sum("w")).alias("m" + c) for c in "xyuv"])
    d = {c: F.col(c) - F.col("m" + c) for c in "xyuv"}
    sums = rows.join(mean, by).groupBy(by, "mx", "my", "mu", "mv").agg(
        F.sum(w * (d["x"] * d["u"] + d["y"] * d["v"])).alias("dot"), F.sum(w * (d["x"] * d["v"] - d["y"] * d["u"])).alias("cross"), F.sum(w * (d["x"] * d["x"] + d["y"] * d["y"])).alias("var")
    )
    a, b = F.col("dot") / F.nullif("var", F.lit(0.0)), F.col("cross") / F.nullif("var", F.lit(0.0))
    return sums.select(by, F.hypot(a, b).alias("scale"), F.degrees(F.atan2(b, a)).alias("angle"), (F.col("mu") - a * F.col("mx") + b * F.col("my")).alias("dx"), (F.col("mv") - b * F.col("mx") - a * F.col("my")).alias("dy"))


def fused(first: DataFrame, second: DataFrame, by: str, t: str, key: str, blend: float = 0.42, middle: float = 0.06, far: float = 0.12) -> tuple[DataFrame, DataFrame]:
    """first's positions drawn to second's where both agree: (rows, gates).

    second is read at first's times, aligned to it robustly, and accepted where
    the median and p95 distance are at most 6 and 12 % of first's span. An
    accepted run moves by `blend` times the sine of its share of rows, so that
    its ends stay; others stay as they are.
    """
    from pyspark.sql import Window

    # Both sides are made once, and dealt so that a task's windows don't grow with the table.
    first, second = stored(first.select(by, key, t, "x", "y"), "first"), stored(second.select(by, t, "x", "y"), "second")
    parts = max(int(first.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(first.count() + second.count()) // ROWS_A_TASK))
    at = as_of(first, second.select(by, t, F.col("x").alias("u")), by, t, "u", parts=parts)
    at = stored(as_of(stored(at, "at"), second.select(by, t, F.col("y").alias("v")), by, t, "v", parts=parts).filter("u is not null and v is not null"), "at")
    fit = robust_similarity(at.select(by, F.col("u").alias("x"), F.col("v").alias("y"), F.col("x").alias("u"), F.col("y").alias("v")), by)
    turned = F.radians("angle")
    moved = at.join(fit, by).withColumns({
        "ax": F.col("scale") * (F.cos(turned) * F.col("u") - F.sin(turned) * F.col("v")) + F.col("dx"),
        "ay": F.col("scale") * (F.sin(turned) * F.col("u") + F.cos(turned) * F.col("v")) + F.col("dy"),
    }).withColumn("off", F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y")))
    moved = stored(moved, "moved")
    gates = grouped_percentiles(moved, by, "off", [0.5, 0.95]).join(moved.groupBy(by).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"), F.count(F.lit(1)).alias("n")), by)
    ratio = lambda k: F.col("p")[k] / F.greatest("span", F.lit(1e-12))
    gates = stored(gates.select(by, "n", ratio(0).alias("median_ratio"), ratio(1).alias("p95_ratio"), F.coalesce((F.col("n") >= 6) & (ratio(0) <= middle) & (ratio(1) <= far), F.lit(False)).alias("accepted")), "gates")
    w, whole = Window.partitionBy(by).orderBy(t, key), Window.partitionBy(by)
    share = (F.row_number().over(w) - 1) / F.greatest(F.lit(1), F.count(F.lit(1)).over(whole) - 1)
    rows = moved.join(gates.select(by, "accepted"), by).repartition(parts, by).withColumn("pull", F.when(F.col("accepted"), blend * F.sin(math.pi * share)).otherwise(0.0))
    return rows.select(by, key, t, (F.col("x") + F.col("pull") * (F.col("ax") - F.col("x"))).alias("x"), (F.col("y") + F.col("pull") * (F.col("ay") - F.col("y"))).alias("y"), "accepted"), gates


#: Points of a frame that are held against its planes at once.
POINTS_A_BLOCK = 256


def floor_planes(points: DataFrame, up: tuple[float, float, float], rounds: int = 72, by: str = "frame") -> DataFrame:
    """The floor seen in each frame of 80 points or more: (frame, height, inliers, alignment, residual).

    Random triples, seeded by the frame, propose planes within 39 degrees of
    `up`; that with the best share of points within 1.2 % of the median depth is
    fitted again. Frames without a sure floor, or with a missing number, have no row.

    A frame may span many tasks: its points are held against the planes in
    blocks, and medians and sums are aggregates. One task holds a frame's
    triples and, to draw them, one number for each of its points.
    """
    want = np.array(up, float) / np.linalg.norm(up)
    rows = stored(with_position(points.select(by, "id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), by, "id"), "points")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in "xyz"])
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("base"), F.max(missing).alias("missing")).filter("n >= 80 and not missing")
    depth = _median(rows, by, F.sqrt(F.expr("x * x + y * y + z * z")), "depth")
    frames = stored(sizes.join(depth, by).select(by, "n", "base", F.greatest(0.012 * F.col("depth"), F.lit(1e-5)).alias("near")), "frames")

    @F.arrow_udf(ArrayType(LongType()))
    def drawn(frame: pa.Array, n: pa.Array) -> pa.Array:
        out = []
        for f, many in zip(frame.to_pylist(), n.to_pylist(), strict=True):
            rng = np.random.RandomState((int(f) + 17) % (1 << 32))
            out.append([int(k) for _ in range(rounds) for k in rng.choice(many, 3, replace=False)])
        return pa.array(out, pa.list_(pa.int64()))

    def planes(rows: pd.DataFrame) -> pd.DataFrame:
        pick = rows.sort_values("k")[["x", "y", "z"]].to_numpy(float).reshape(-1, 3, 3)
        normal = np.cross(pick[:, 1] - pick[:, 0], pick[:, 2] - pick[:, 0])
        size = np.linalg.norm(normal, axis=1)
        normal, pick = normal[size > 1e-9] / size[size > 1e-9, None], pick[size > 1e-9]
        keep = np.abs(normal @ want) >= 0.78
        normal, pick = normal[keep], pick[keep]
        flat = np.column_stack([normal, (pick[:, 0] * normal).sum(axis=1)])
        return pd.DataFrame({by: [rows[by].iloc[0]], "planes": [flat.reshape(-1).tolist()]})

    @F.arrow_udf(ArrayType(LongType()))
    def inside(xs: pa.Array, ys: pa.Array, zs: pa.Array, planes: pa.Array, near: pa.Array) -> pa.Array:
        out = []
        for x, y, z, p, limit in zip(xs, ys, zs, planes, near.to_pylist(), strict=True):
            x, y, z = (v.values.to_numpy(zero_copy_only=False)[:, None] for v in (x, y, z))
            a, b, c, d = p.values.to_numpy(zero_copy_only=False).reshape(-1, 4).T
            out.append((np.abs(x * a + y * b + z * c - d) <= limit).sum(axis=0).tolist())
        return pa.array(out, pa.list_(pa.int64()))

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = frames.repartition(tasks, by).select(by, "base", F.posexplode(drawn(by, "n")).alias("k", "at")).select(by, "k", (F.col("base") + F.col("at")).alias("pos"))
    found = rows.join(picks, [by, "pos"]).groupBy(by).applyInPandas(planes, f"{by} long, planes array<double>")
    found = stored(found.filter(F.size("planes") > 0).join(frames, by), "planes")
    blocks = rows.groupBy(by, F.floor(F.col("pos") / POINTS_A_BLOCK).alias("block")).agg(*[F.collect_list(c).alias(c) for c in "xyz"])
    counts = blocks.join(found.select(by, "planes", "near"), by).select(by, F.posexplode(inside("x", "y", "z", "planes", "near")).alias("plane", "inside"))
    counts = counts.groupBy(by, "plane").agg(F.sum("inside").alias("inside")).join(found, by)
    a, b, c, d = (F.col("planes")[4 * F.col("plane") + k] for k in range(4))
    aligned = F.abs(a * float(want[0]) + b * float(want[1]) + c * float(want[2]))
    one = F.struct((F.col("inside") / F.col("n") * (aligned * aligned)).alias("score"), (-F.col("plane")).alias("first"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), "inside", "n", "near")
    best = counts.groupBy(by).agg(F.max(one).alias("o")).select(by, "o.*").filter("inside >= 60")
    kept = stored(rows.join(best, by).filter("abs(x * a + y * b + z * c - d) <= near").select(by, "x", "y", "z", "n"), "inliers")
    centre = reduce(lambda l, r: l.join(r, by), [_median(kept, by, F.col(c), f"m{c}") for c in "xyz"])
    moved = kept.join(centre, by).select(by, "n", "mx", "my", "mz", *[(F.col(c) - F.col(f"m{c}")).alias(f"d{c}") for c in "xyz"])
    sums = F.array(*[F.sum(F.col(f"d{p}") * F.col(f"d{q}")) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")])

    @F.arrow_udf(NUMBERS)
    def normals(cov: pa.Array) -> pa.Array:
        m = np.array(cov.to_pylist(), float).reshape(-1, 6)
        n = np.linalg.eigh(m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))[1][:, :, 0]
        return pa.array((n * np.where(n @ want < 0, -1.0, 1.0)[:, None]).tolist(), pa.list_(pa.float64()))

    fit = moved.groupBy(by, "n", "mx", "my", "mz").agg(F.count(F.lit(1)).alias("inside"), sums.alias("cov")).withColumn("normal", normals("cov"))
    u = [F.col("normal")[k] for k in range(3)]
    fit = stored(fit.select(by, (F.col("inside") / F.col("n")).alias("inliers"), F.abs(F.col("mx") * u[0] + F.col("my") * u[1] + F.col("mz") * u[2]).alias("height"), (u[0] * float(want[0]) + u[1] * float(want[1]) + u[2] * float(want[2])).alias("alignment"), u[0].alias("a"), u[1].alias("b"), u[2].alias("c")), "fit")
    off = _median(moved.join(fit, by), by, F.abs(F.expr("dx * a + dy * b + dz * c")), "off")
    out = fit.join(off, by).select(by, "height", "inliers", "alignment", (F.col("off") / F.greatest("height", F.lit(1e-12))).alias("residual"))
    return out.filter("height > 1e-6 and alignment >= 0.82 and residual <= 0.045 and inliers >= 0.12")
