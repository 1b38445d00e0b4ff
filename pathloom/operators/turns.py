"""Turns of a route: curvature sessions, the camera's heading, and which of them counts.

Sessions are islands over windows; only the repair of a single deviating sign and the
choice of turns far enough apart carry a decision from row to row, and these fold.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .joins import merged
from .kernels import folded
from .ranking import grouped_percentiles
from .series import S, Series, direction, wrap_degrees

#: Curvature in degrees per median step and yaw rate in degrees per second that count as turning, and the least angle of a session.
CURVED, YAW_RATE, LEAST_ANGLE = 0.35, 3.0, 12.0
#: Fixed values of the camera's say: concentration of its headings, angles it may have, share of it that the path shows at most.
SURE, CAMERA_LEAST, CAMERA_MOST, PATH_SHARE = 0.8, 32.0, 150.0, 0.8
#: Fixed values of reported turns: least angle, that of a weak pose, that of a u-turn.
REPORTED, WEAK_REPORTED, U_TURN = 28.0, 45.0, 135.0
#: Fixed values of a camera axis: alignment and support that make it reliable, and the angle that supports it.
ALIGNED, SUPPORTED, WITHIN = 0.55, 0.65, 55.0


def rated(df: DataFrame, angle: str = "heading", s: Series = S) -> DataFrame:
    """Rows (run, t, tie, x, y, angle, k, n, half, dist, arc, unit, rate, curvature, yaw) of each run.

    k counts from 0; dist and the rates belong to the step to the next row and
    are null in a run's last row. `half` is 2, or a 90th of the run up to 8.
    """
    w = s.ordered
    rows = df.select(s.run, s.t, s.tie, s.x, s.y, angle, (F.row_number().over(w) - 1).cast("long").alias("k"), F.count(F.lit(1)).over(s.whole).alias("n"))
    ahead = lambda c: F.lead(c).over(w) - F.col(c)
    rows = rows.withColumns({
        "half": F.greatest(F.lit(2), F.least(F.lit(8), F.floor(F.col("n") / 90))).cast("long"),
        "raw": F.when(F.col("k") < F.col("n") - 1, wrap_degrees(ahead(angle))), "dist": F.sqrt(ahead(s.x) * ahead(s.x) + ahead(s.y) * ahead(s.y)), "dt": ahead(s.t),
    })
    a, b, c = F.lag("raw").over(w), F.col("raw"), F.lead("raw").over(w)
    middle = a + b + c - F.greatest(a, b, c) - F.least(a, b, c)
    rows = rows.withColumn("mid", F.when(b.isNotNull(), F.when(F.col("n") < 4, b).otherwise(F.coalesce(middle, (F.coalesce(a, c) + b) / 2))))
    zero = lambda f: F.coalesce(f("mid").over(w), F.lit(0.0))
    rows = rows.withColumn("rate", F.when(F.col("n") < 4, F.col("mid")).otherwise(0.25 * zero(F.lag) + 0.5 * F.col("mid") + 0.25 * zero(F.lead)))
    rows = stored(rows.withColumn("arc", F.coalesce(F.sum("dist").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))), "rates")
    unit = grouped_percentiles(rows.filter("dist > 1e-9"), s.run, "dist", [0.5]).select(s.run, F.col("p")[0].alias("unit"))
    rows = rows.join(unit, s.run, "left").withColumn("unit", F.coalesce("unit", F.lit(1.0)))
    return rows.select(
        s.run, s.t, s.tie, s.x, s.y, angle, "k", "n", "half", "dist", "arc", "unit", "rate", (F.col("rate") / F.greatest(F.col("dist") / F.greatest("unit", F.lit(1e-9)), F.lit(0.15))).alias("curvature"),
        F.when((F.col("dt") > 1e-4) & (F.col("dt") < 10), F.col("rate") / F.col("dt")).alias("yaw"),
    )


def repaired(rows: DataFrame, s: Series = S) -> DataFrame:
    """rows with `sign`: that of the rate where it counts as turning, else 0; a sign between two
    equal ones takes theirs, from the first row on."""
    by = Series(s.run, "k", "k")  # times and identifiers may repeat
    w = by.ordered
    turning = (F.abs("curvature") >= CURVED) | F.coalesce(F.abs("yaw") >= YAW_RATE, F.lit(False))
    signs = rows.filter("rate is not null").select(s.run, "k", F.when(turning, F.signum("rate")).otherwise(0.0).cast("int").alias("sign"))
    signs = signs.withColumns({"first": (F.row_number().over(w) == 1), "next": F.coalesce(F.lead("sign").over(w), F.lit(0))})

    def step(state, part):
        out = np.empty(len(part), np.int64)
        before = state.get("before", 0)
        for k, (now, first, after) in enumerate(zip(part["sign"].to_numpy(), part["first"].to_numpy(), part["next"].to_numpy(), strict=True)):
            before = out[k] = before if not first and before != 0 and before == after != now else now
        state["before"] = int(before)
        return pd.DataFrame({s.run: part[s.run].to_numpy(), "k": part["k"].to_numpy(), "sign": out})

    done = folded(signs, by, dict, step, f"{s.run} {rows.schema[s.run].dataType.simpleString()}, k long, sign int")
    return rows.join(done, [s.run, "k"], "left")


def _in_order(rows: DataFrame, s: Series) -> DataFrame:
    """rows by session, the last one first, as DuckDB's join hands them to the sums of the SQL: their
    last bit decides to which side a mean row halfway between two rows goes."""
    return rows.repartition(s.run, "key").sortWithinPartitions(s.run, "key", F.desc("k"))


def _islands(rows: DataFrame, apart: Column, s: Series) -> DataFrame:
    """Rows numbered anew wherever `apart` from the row before, or of another sign."""
    w = Window.partitionBy(s.run).orderBy("first")
    new = F.when((F.lag("sign").over(w) == F.col("sign")) & ~apart, 0).otherwise(1)
    return rows.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def mean_heading(rows: DataFrame, spans: DataFrame, angle: str, name: str, s: Series = S) -> DataFrame:
    """spans (run, key, lo, hi) with the circular mean (degrees) and concentration of the angles of rows lo to hi."""
    at = merged(spans.select(s.run, "key", F.explode(F.sequence("lo", "hi")).alias("k"))).join(rows.select(s.run, "k", F.radians(angle).alias("a")), [s.run, "k"])
    mean = _in_order(at, s).groupBy(s.run, "key").agg(F.avg(F.sin("a")).alias("sin"), F.avg(F.cos("a")).alias("cos"))
    sure = F.hypot("sin", "cos")
    return mean.select(s.run, "key", F.when(sure > 1e-8, direction("sin", "cos")).alias(name), F.when(sure > 1e-8, sure).otherwise(0.0).alias(f"{name}_sure"))


def sessions(df: DataFrame, angle: str = "heading", s: Series = S) -> tuple[DataFrame, DataFrame]:
    """Turn sessions of each run, and its rows as `rated` gives them.

    Sessions (run, key, first, last, sign, start, stop, angle, centre, support,
    peak_curvature, peak_yaw): rows `first` to `last` turn to one side; a gap
    longer than max(2.5, half) median steps parts them, and neighbours to one side
    within max(4, 2 half) join again. The angle is that between the mean
    headings beside [start, stop]; sessions under 12 degrees, or whose angle
    has the other sign, are left out.
    """
    rows = stored(repaired(rated(df, angle, s), s), "turning")
    w = Window.partitionBy(s.run).orderBy("k")
    active = rows.filter("sign <> 0").select(s.run, F.col("k").alias("first"), F.col("k").alias("last"), "sign", "half", "unit", "n", "arc", (F.col("arc") + F.coalesce("dist", F.lit(0.0))).alias("after"))
    # The gap is measured to the last quiet row before this one.
    quiet = rows.select(s.run, F.col("k").alias("first"), F.lag("arc").over(w).alias("quiet"))
    active = active.join(quiet, [s.run, "first"])
    v = Window.partitionBy(s.run).orderBy("first")
    gap = (F.col("first") - F.lag("last").over(v) > 1) & (F.col("quiet") - F.lag("arc").over(v) > F.greatest(F.lit(2.5), F.col("half").cast("double")) * F.col("unit"))
    parts = _islands(active, gap, s).groupBy(s.run, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("sign").alias("sign"), F.first("half").alias("half"), F.first("unit").alias("unit"), F.first("n").alias("n"), F.min("arc").alias("arc0"), F.max("arc").alias("arc1")).drop("island")
    far = F.col("arc0") - F.lag("arc1").over(v) > F.greatest(F.lit(4.0), 2.0 * F.col("half")) * F.col("unit")
    joined = _islands(parts, far, s).groupBy(s.run, F.col("island").alias("key")).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("sign").alias("sign"), F.first("half").alias("half"), F.first("n").alias("n"))
    wide = F.greatest(F.lit(3), F.col("half"))
    joined = joined.withColumns({"start": F.greatest(F.lit(0), F.col("first") - F.col("half")), "stop": F.least(F.col("n") - 1, F.col("last") + 1 + F.col("half")), "wide": wide})
    joined = stored(joined, "sessions")
    before = mean_heading(rows, joined.select(s.run, "key", F.greatest(F.lit(0), F.col("start") - F.col("wide")).alias("lo"), F.col("start").alias("hi")), angle, "before", s)
    after = mean_heading(rows, joined.select(s.run, "key", F.col("stop").alias("lo"), F.least(F.col("n") - 1, F.col("stop") + F.col("wide")).alias("hi")), angle, "after", s)
    inside = merged(joined.select(s.run, "key", "first", "last", "start", "stop", F.explode(F.sequence("start", "stop")).alias("k"))).join(rows.select(s.run, "k", "rate", "dist", "curvature", "yaw"), [s.run, "k"])
    own = F.col("k").between(F.col("first"), F.col("last"))
    size = F.when(own, F.abs("rate"))
    seen = _in_order(inside, s).groupBy(s.run, "key").agg(
        (F.sum(size * F.col("k")) / F.sum(size)).alias("middle"), F.coalesce(F.sum(F.when(F.col("k") < F.col("stop"), F.col("dist"))), F.lit(0.0)).alias("support"),
        F.max(F.when(own, F.abs("curvature"))).alias("peak_curvature"), F.max(F.when(own, F.abs("yaw"))).alias("peak_yaw"),
    )
    out = joined.join(before, [s.run, "key"]).join(after, [s.run, "key"]).join(seen, [s.run, "key"]).withColumn("angle", wrap_degrees(F.col("after") - F.col("before")))
    out = out.filter((F.abs("angle") >= LEAST_ANGLE) & (F.signum("angle") == F.col("sign")))
    centre = F.least(F.col("n") - 1, F.round("middle").cast("long") + 1)
    return out.select(s.run, "key", "first", "last", "sign", "start", "stop", "half", "angle", centre.alias("centre"), "support", "peak_curvature", "peak_yaw"), rows


def camera_heading(rows: DataFrame, rotations: DataFrame, basis: DataFrame, angle: str = "heading", s: Series = S) -> tuple[DataFrame, DataFrame]:
    """The camera's headings (run, k, camera) on the plan, and what speaks for them (run, axis, valid, alignment, support, reliable).

    rotations (run, k, rotation: nine numbers, camera to world), basis (run, xx to
    nz: the floor's axes). The camera's Z and X axes are laid into the floor; a
    run's axis is that with the larger product of median alignment with the
    path's heading and share within 55 degrees, turned round as a whole where
    it points backwards. A run needs headings in a fifth of its rows, 6 to 40
    of them; without, it has no rows.
    """
    at = rows.select(s.run, "k", "n", angle).join(rotations, [s.run, "k"]).join(basis, s.run)
    good = (F.size("rotation") == 9) & F.forall("rotation", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sides = at.filter(good).withColumn("axis", F.explode(F.array(F.lit(2), F.lit(0))))
    d = [F.col("rotation")[F.col("axis") + 3 * r] for r in range(3)]
    dot = lambda p: sum((d[r] * F.col(p + a) for r, a in ((1, "y"), (2, "z"))), d[0] * F.col(p + "x"))
    flat = F.sqrt(F.greatest(F.lit(0.0), d[0] ** 2 + d[1] ** 2 + d[2] ** 2 - dot("n") ** 2))
    sides = sides.filter(flat > 1e-7).select(s.run, "k", "n", "axis", F.degrees(F.atan2(dot("y"), dot("x"))).alias("camera"), F.concat_ws("/", s.run, "axis").alias("side"), angle)
    sides = stored(sides.filter(F.col(angle).isNotNull()).withColumn("cos", F.cos(F.radians(F.col("camera") - F.col(angle)))), "camera")
    middle = grouped_percentiles(sides, "side", "cos", [0.5]).select("side", F.col("p")[0].alias("middle"))
    near = math.cos(math.radians(WITHIN))
    per = sides.groupBy(s.run, "axis", "side").agg(F.count(F.lit(1)).alias("valid"), F.max("n").alias("n"), F.avg((F.col("cos") >= near).cast("double")).alias("with"), F.avg((F.col("cos") <= -near).cast("double")).alias("against")).join(middle, "side")
    back = F.col("middle") < 0
    per = per.filter(F.col("valid") >= F.greatest(F.lit(6), F.least(F.lit(40), F.floor(F.col("n") / 5)))).select(s.run, "axis", "valid", F.abs("middle").alias("alignment"), F.when(back, F.col("against")).otherwise(F.col("with")).alias("support"), back.alias("back"))
    best = per.groupBy(s.run).agg(F.max(F.struct((F.col("alignment") * F.col("support")).alias("score"), "axis", "valid", "alignment", "support", "back")).alias("b")).select(s.run, "b.*")
    best = stored(best.withColumn("reliable", (F.col("alignment") >= ALIGNED) & (F.col("support") >= SUPPORTED)), "axes")
    found = sides.join(best.select(s.run, "axis", "back"), [s.run, "axis"]).select(s.run, "k", (F.col("camera") + F.when(F.col("back"), 180.0).otherwise(0.0)).alias("camera"))
    return found, best.select(s.run, "axis", "valid", "alignment", "support", "reliable")


def observed(found: DataFrame, cameras: DataFrame, axes: DataFrame, s: Series = S) -> DataFrame:
    """Sessions with `camera_angle`, and `event_angle` with its `source`: the camera's angle where it is
    reliable and sure, turns the same way by 32 to 150 degrees, and the path shows less than 0.8 of it."""
    seen = found.join(axes.filter("reliable").select(s.run), s.run, "left_semi")
    wide = F.greatest(F.lit(3), F.col("half"))
    before = mean_heading(cameras, seen.select(s.run, "key", F.greatest(F.lit(0), F.col("start") - wide).alias("lo"), F.col("start").alias("hi")), "camera", "cam0", s)
    after = mean_heading(cameras, seen.select(s.run, "key", F.col("stop").alias("lo"), (F.col("stop") + wide).alias("hi")), "camera", "cam1", s)
    turn = before.join(after, [s.run, "key"]).filter((F.col("cam0_sure") >= SURE) & (F.col("cam1_sure") >= SURE)).select(s.run, "key", wrap_degrees(F.col("cam1") - F.col("cam0")).alias("camera_angle"))
    rows = found.join(turn, [s.run, "key"], "left")
    better = (F.signum("angle") == F.signum("camera_angle")) & (F.abs("camera_angle") >= CAMERA_LEAST) & (F.abs("camera_angle") < CAMERA_MOST) & (F.abs("angle") < PATH_SHARE * F.abs("camera_angle"))
    better = F.coalesce(better, F.lit(False))
    return rows.withColumns({"event_angle": F.when(better, F.col("camera_angle")).otherwise(F.col("angle")), "source": F.when(better, "camera").otherwise("path")})


def reported(events: DataFrame, rows: DataFrame, confidence: DataFrame | None = None, s: Series = S) -> DataFrame:
    """Turns (run, centre, angle, kind, source) of sessions with event_angle and source.

    28 degrees at least, with some way travelled; at a weak pose (no confidence,
    or among the lowest 12 % of the run's) 45, or a span of max(3, 2 half); and
    max(3, half) rows after the turn kept before. confidence has rows (run, k, conf).
    """
    kept = events.filter((F.abs("event_angle") >= REPORTED) & (F.col("support") > 1e-6))
    if confidence is not None:
        sure = confidence.filter("conf is not null and not isnan(conf)")
        many = sure.groupBy(s.run).agg(F.count(F.lit(1)).alias("m")).filter("m >= 5")
        low = grouped_percentiles(sure.join(many, s.run, "left_semi"), s.run, "conf", [0.12]).select(s.run, F.col("p")[0].alias("low"))
        kept = kept.join(sure.select(s.run, F.col("k").alias("centre"), "conf"), [s.run, "centre"], "left").join(low, s.run, "left")
        weak = F.col("conf").isNull() | F.coalesce(F.col("conf") <= F.col("low"), F.lit(False))
        kept = kept.filter(~(weak & (F.abs("event_angle") < WEAK_REPORTED) & (F.col("stop") - F.col("start") < F.greatest(F.lit(3), 2 * F.col("half")))))

    def step(state, part):
        out = []
        for run, centre, angle, source, half in part[[s.run, "centre", "event_angle", "source", "half"]].itertuples(index=False):
            if "last" not in state or centre - state["last"] >= max(3, half):
                state["last"] = centre
                out.append((run, centre, angle, "u_turn" if abs(angle) >= U_TURN else "left" if angle > 0 else "right", source))
        return pd.DataFrame(out, columns=[s.run, "centre", "angle", "kind", "source"])

    kind = events.schema[s.run].dataType.simpleString()
    return folded(kept, Series(s.run, "key", "centre"), dict, step, f"{s.run} {kind}, centre long, angle double, kind string, source string")
