"""The vertical of a camera's run, and its positions on the floor.

Turns of a camera share the vertical as their axis. Axes of relative rotations are
added up as six sums per run; only the eigenvectors of these 3 x 3 sums are Python,
one row for each run.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..sources.shared import stored
from .alignment import floor_basis
from .ranking import grouped_percentiles

#: Distances in frames of relative rotations, angles that count, the angle from which they weigh no more, least samples.
SPANS, LEAST, MOST, FULL, SAMPLES = (4, 8, 16, 24), math.radians(1.5), math.radians(75.0), math.radians(30.0), 12
#: Dominance and alignment of a sure axis, ratios of a plane that counts, coherence of the camera's up.
DOMINANT, UPRIGHT, SECOND, FLAT, COHERENT = 2.0, 0.45, 0.035, 0.35, 0.55


@F.arrow_udf(ArrayType(DoubleType()))
def eigen(sums: pa.Array) -> pa.Array:
    """Per six sums (xx, xy, xz, yy, yz, zz): three rising eigenvalues, the vector of the last, the vector of the first."""
    c = np.array(sums.to_pylist(), float).reshape(-1, 6)
    values, vectors = np.linalg.eigh(c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
    return pa.array(np.concatenate([values, vectors[:, :, 2], vectors[:, :, 0]], axis=1).tolist(), pa.list_(pa.float64()))


def _usable(poses: DataFrame) -> DataFrame:
    """Poses whose rotation columns have length one and are right-handed, to two hundredths."""
    e = lambda r, c: F.col("pose")[4 * r + c]
    dot = lambda a, b: sum(e(r, a) * e(r, b) for r in range(3))
    det = e(0, 0) * (e(1, 1) * e(2, 2) - e(1, 2) * e(2, 1)) - e(0, 1) * (e(1, 0) * e(2, 2) - e(1, 2) * e(2, 0)) + e(0, 2) * (e(1, 0) * e(2, 1) - e(1, 1) * e(2, 0))
    finite = F.forall("pose", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    right = [F.abs(dot(a, a) - 1) <= 0.02 for a in range(3)] + [F.abs(dot(a, b)) <= 0.02 for a, b in ((0, 1), (0, 2), (1, 2))] + [F.abs(det - 1) <= 0.05]
    out = finite & (F.size("pose") == 16)
    for r in right:
        out = out & r
    return poses.filter(F.coalesce(out, F.lit(False)))


def _unit(x, y, z):
    size = F.greatest(F.sqrt(x * x + y * y + z * z), F.lit(1e-12))
    return x / size, y / size, z / size


def camera_up(poses: DataFrame, run: str = "run") -> DataFrame:
    """The cameras' physical up (run, ux, uy, uz, coherence) of runs with three usable poses: the
    median of -Y in the hemisphere of the first, and the median of their agreement with it."""
    w = Window.partitionBy(run).orderBy("frame")
    up = _usable(poses).select(run, "frame", *[(-F.col("pose")[4 * r + 1]).alias(f"u{a}") for r, a in enumerate("xyz")])
    up = up.withColumns({f"f{a}": F.first(f"u{a}").over(w) for a in "xyz"} | {"n": F.count(F.lit(1)).over(Window.partitionBy(run))}).filter("n >= 3")
    side = F.when(F.expr("ux * fx + uy * fy + uz * fz") >= 0, 1.0).otherwise(-1.0)
    up = stored(up.select(run, *[(F.col(f"u{a}") * side).alias(f"u{a}") for a in "xyz"]), "up")
    middle = up.select(run).distinct()
    for a in "xyz":
        middle = middle.join(grouped_percentiles(up, run, f"u{a}", [0.5]).select(run, F.col("p")[0].alias(f"m{a}")), run)
    x, y, z = _unit(F.col("mx"), F.col("my"), F.col("mz"))
    middle = stored(middle.select(run, x.alias("mx"), y.alias("my"), z.alias("mz")), "up")
    agree = grouped_percentiles(up.join(middle, run), run, F.expr("ux * mx + uy * my + uz * mz"), [0.5])
    return middle.join(agree, run).select(run, F.col("mx").alias("ux"), F.col("my").alias("uy"), F.col("mz").alias("uz"), F.col("p")[0].alias("coherence"))


def turn_axis(poses: DataFrame, run: str = "run") -> DataFrame:
    """The common axis of a run's turns (run, ax, ay, az, dominance, samples) from 12 usable relative rotations on.

    Rotations between frames 4, 8, 16 and 24 rows apart by 1.5 to 75 degrees count by
    their squared angle, up to 30; `dominance` is the ratio of the two largest eigenvalues.
    """
    w = Window.partitionBy(run).orderBy("frame")
    rows = poses.select(run, "frame", "pose")
    ahead = rows.select(run, "pose", F.array(*[F.lead("pose", g).over(w) for g in SPANS]).alias("ahead"))
    far = ahead.select(run, "pose", F.explode("ahead").alias("to")).filter("to is not null")
    far = _usable(_usable(far).select(run, F.col("pose").alias("from"), F.col("to").alias("pose")))
    a, b = (lambda r, c: F.col("from")[4 * r + c]), (lambda r, c: F.col("pose")[4 * r + c])
    m = lambda r, c: sum(b(r, k) * a(c, k) for k in range(3))
    skew = far.select(run, (m(2, 1) - m(1, 2)).alias("x"), (m(0, 2) - m(2, 0)).alias("y"), (m(1, 0) - m(0, 1)).alias("z"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (m(0, 0) + m(1, 1) + m(2, 2) - 1) / 2))).alias("angle"))
    size = F.sqrt(F.expr("x * x + y * y + z * z"))
    good = skew.withColumn("size", size).filter((F.col("size") > 1e-8) & F.col("angle").between(LEAST, MOST)).withColumn("weight", F.least("angle", F.lit(FULL)) ** 2 / F.col("size") ** 2)
    sums = good.groupBy(run).agg(F.count(F.lit(1)).alias("samples"), F.array(*[F.sum(F.col("weight") * F.col(p) * F.col(q)) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("sums")).filter(F.col("samples") >= SAMPLES)
    e = F.col("e")
    return sums.select(run, "samples", eigen("sums").alias("e")).filter(e[2] > 1e-12).select(run, e[3].alias("ax"), e[4].alias("ay"), e[5].alias("az"), (e[2] / F.greatest(e[1], F.lit(1e-12))).alias("dominance"), "samples")


def path_normal(poses: DataFrame, run: str = "run") -> DataFrame:
    """The direction in which a run of six positions or more varies least (run, px, py, pz, second, flat): ratios of its singular values."""
    rows = poses.select(run, *[F.col("pose")[4 * r + 3].alias(a) for r, a in enumerate("xyz")])
    middle = rows.groupBy(run).agg(F.count(F.lit(1)).alias("n")).filter("n >= 6")
    for a in "xyz":
        middle = middle.join(grouped_percentiles(rows, run, a, [0.5]).select(run, F.col("p")[0].alias(f"m{a}")), run)
    d = {a: F.col(a) - F.col(f"m{a}") for a in "xyz"}
    sums = rows.join(middle, run).groupBy(run).agg(F.array(*[F.sum(d[p] * d[q]) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]).alias("sums"))
    e = F.col("e")
    value = lambda k: F.sqrt(F.greatest(e[k], F.lit(0.0)))
    return sums.select(run, eigen("sums").alias("e")).filter(value(2) > 1e-8).select(run, e[6].alias("px"), e[7].alias("py"), e[8].alias("pz"), (value(1) / F.greatest(value(2), F.lit(1e-9))).alias("second"), (value(0) / F.greatest(value(1), F.lit(1e-9))).alias("flat"))


def floors(poses: DataFrame, run: str = "run") -> DataFrame:
    """The floor's axes of each run (run, xx to nz, method) of poses (run, frame, pose: 16 numbers, camera to world).

    The normal is the sure axis of its turns, else that of a path that covers
    a plane, else the cameras' coherent up, else the path's after all, else -Y;
    it points up as the cameras do, or its largest number is positive. X is the
    first position off the start, laid into the floor, else the last, else an axis.
    """
    runs = poses.select(run).distinct()
    rows = runs.join(camera_up(poses, run), run, "left").join(turn_axis(poses, run), run, "left").join(path_normal(poses, run), run, "left")
    toward = lambda p: F.expr(f"{p}x * ux + {p}y * uy + {p}z * uz")

    def signed(p):
        largest = F.when((F.abs(f"{p}x") >= F.abs(f"{p}y")) & (F.abs(f"{p}x") >= F.abs(f"{p}z")), F.col(f"{p}x")).when(F.abs(f"{p}y") >= F.abs(f"{p}z"), F.col(f"{p}y")).otherwise(F.col(f"{p}z"))
        return F.when(F.coalesce(toward(p), largest) < 0, -1.0).otherwise(1.0)

    def normal(p, name):
        return F.struct(*[(F.col(f"{p}{a}") * signed(p)).alias(f"n{a}") for a in "xyz"], F.lit(name).alias("method"))

    sure = (F.col("dominance") >= DOMINANT) & F.coalesce(F.abs(toward("a")) >= UPRIGHT, F.lit(True))
    up = F.struct(*[F.col(f"u{a}").alias(f"n{a}") for a in "xyz"], F.lit("camera_up").alias("method"))
    chosen = (
        F.when(sure, normal("a", "turn_axis")).when((F.col("second") >= SECOND) & (F.col("flat") <= FLAT), normal("p", "path_plane"))
        .when(F.col("coherence") >= COHERENT, up).when(F.col("px").isNotNull(), normal("p", "weak_path_plane"))
        .otherwise(F.struct(F.lit(0.0).alias("nx"), F.lit(-1.0).alias("ny"), F.lit(0.0).alias("nz"), F.lit("minus_y").alias("method")))
    )
    rows = stored(rows.select(run, chosen.alias("n")).select(run, "n.*"), "normals")
    w = Window.partitionBy(run).orderBy("frame")
    moved = poses.select(run, "frame", *[(F.col("pose")[4 * r + 3] - F.first(F.col("pose")[4 * r + 3]).over(w)).alias(f"h{a}") for r, a in enumerate("xyz")]).join(rows, run)
    on = F.expr("hx * nx + hy * ny + hz * nz")
    off = F.sqrt(F.greatest(F.lit(0.0), F.expr("hx * hx + hy * hy + hz * hz") - on * on))
    heads = moved.withColumn("off", off).filter("off > 1e-6").groupBy(run).agg(F.min_by(F.struct("hx", "hy", "hz"), "frame").alias("h"))
    spare = F.when(F.abs("nx") < 0.9, F.struct(F.lit(1.0).alias("hx"), F.lit(0.0).alias("hy"), F.lit(0.0).alias("hz"))).otherwise(F.struct(F.lit(0.0).alias("hx"), F.lit(0.0).alias("hy"), F.lit(1.0).alias("hz")))
    heads = rows.join(heads, run, "left").select(run, F.coalesce("h", spare).alias("h")).select(run, "h.*")
    normals = rows.select(run, F.lit(1).alias("priority"), "nx", "ny", "nz", F.lit(1.0).alias("support"), F.lit(0.0).alias("least"))
    return floor_basis(normals, heads, run).join(rows.select(run, "method"), run)


def on_floor(poses: DataFrame, basis: DataFrame, run: str = "run") -> DataFrame:
    """Positions (run, frame, x, y, z) from the run's first one: forward, left and up."""
    w = Window.partitionBy(run).orderBy("frame")
    rows = poses.select(run, "frame", *[(F.col("pose")[4 * r + 3] - F.first(F.col("pose")[4 * r + 3]).over(w)).alias(f"d{a}") for r, a in enumerate("xyz")]).join(basis, run)
    return rows.select(run, "frame", *[F.expr(f"dx * {p}x + dy * {p}y + dz * {p}z").alias(name) for p, name in (("x", "x"), ("y", "y"), ("n", "z"))])
