"""Queries of turn sessions, the camera's heading, gravity and calibration."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gravity, odometry, turns
from ..operators import series as ops
from .bindings import trajectory
from .catalog import query
from .kernel_queries import _r
from .series_queries import HEADING, W, _wrap

_K = "(PARTITION BY run ORDER BY k)"
_F = "(PARTITION BY run ORDER BY first)"
SESSIONS = f"""WITH RECURSIVE {HEADING}, r0 AS (SELECT run, t, id, x, y, heading, row_number() OVER {W} - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM head WHERE heading IS NOT NULL),
    r1 AS (SELECT *, greatest(2, least(8, n // 90)) AS half, CASE WHEN k < n - 1 THEN {_wrap(f'lead(heading) OVER {_K} - heading')} END AS raw, sqrt(pow(lead(x) OVER {_K} - x, 2) + pow(lead(y) OVER {_K} - y, 2)) AS dist, lead(t) OVER {_K} - t AS dt FROM r0),
    r2 AS (SELECT *, lag(raw) OVER {_K} AS ra, lead(raw) OVER {_K} AS rc FROM r1),
    r3 AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN n < 4 THEN raw WHEN ra IS NULL OR rc IS NULL THEN (coalesce(ra, rc) + raw) / 2 ELSE ra + raw + rc - greatest(ra, raw, rc) - least(ra, raw, rc) END AS mid FROM r2),
    r4 AS (SELECT *, CASE WHEN n < 4 THEN mid ELSE 0.25::DOUBLE * coalesce(lag(mid) OVER {_K}, 0) + 0.5::DOUBLE * mid + 0.25::DOUBLE * coalesce(lead(mid) OVER {_K}, 0) END AS rate, coalesce(sum(dist) OVER (PARTITION BY run ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS arc FROM r3),
    u AS (SELECT run, quantile_cont(dist, 0.5) AS unit FROM r4 WHERE dist > 1e-9 GROUP BY run),
    r5 AS (SELECT r4.*, coalesce(unit, 1) AS unit, rate / greatest(dist / greatest(coalesce(unit, 1), 1e-9), 0.15::DOUBLE) AS curvature, CASE WHEN dt > 1e-4 AND dt < 10 THEN rate / dt END AS yaw FROM r4 LEFT JOIN u USING (run)),
    sg AS (SELECT run, k, CASE WHEN abs(curvature) >= {turns.CURVED} OR coalesce(abs(yaw) >= {turns.YAW_RATE}, false) THEN sign(rate) ELSE 0 END::INT AS s FROM r5 WHERE rate IS NOT NULL),
    sn AS (SELECT *, coalesce(lead(s) OVER {_K}, 0) AS nx FROM sg),
    rep AS (SELECT run, k, s FROM sn WHERE k = 0 UNION ALL SELECT sn.run, sn.k, CASE WHEN rep.s <> 0 AND rep.s = sn.nx AND sn.s <> sn.nx THEN rep.s ELSE sn.s END FROM rep JOIN sn ON sn.run = rep.run AND sn.k = rep.k + 1),
    q AS (SELECT run, k, n, half, unit, arc, rate, dist, curvature, yaw, heading, lag(arc) OVER {_K} AS quiet FROM r5),
    a AS (SELECT q.run, q.k AS first, rep.s AS sign, n, half, unit, arc, quiet FROM q JOIN rep ON q.run = rep.run AND q.k = rep.k WHERE rep.s <> 0),
    b AS (SELECT *, CASE WHEN lag(sign) OVER {_F} = sign AND NOT (first - lag(first) OVER {_F} > 1 AND quiet - lag(arc) OVER {_F} > greatest(2.5::DOUBLE, half) * unit) THEN 0 ELSE 1 END AS nw FROM a),
    c AS (SELECT *, sum(nw) OVER {_F} AS g FROM b),
    p AS (SELECT run, min(first) AS first, max(first) AS last, any_value(sign) AS sign, any_value(half) AS half, any_value(unit) AS unit, any_value(n) AS n, min(arc) AS arc0, max(arc) AS arc1 FROM c GROUP BY run, g),
    e AS (SELECT *, CASE WHEN lag(sign) OVER {_F} = sign AND NOT (arc0 - lag(arc1) OVER {_F} > greatest(4.0::DOUBLE, 2.0::DOUBLE * half) * unit) THEN 0 ELSE 1 END AS nw FROM p),
    f AS (SELECT *, sum(nw) OVER {_F} AS g FROM e),
    j AS (SELECT run, g, min(first) AS first, max(last) AS last, any_value(sign) AS sign, any_value(half) AS half, any_value(n) AS n, greatest(0, min(first) - any_value(half)) AS start, least(any_value(n) - 1, max(last) + 1 + any_value(half)) AS stop, greatest(3, any_value(half)) AS wide FROM f GROUP BY run, g),
    m0 AS (SELECT j.run, g, avg(sin(radians(heading))) AS s, avg(cos(radians(heading))) AS c FROM j JOIN q ON q.run = j.run AND q.k BETWEEN start - wide AND start GROUP BY ALL),
    m1 AS (SELECT j.run, g, avg(sin(radians(heading))) AS s, avg(cos(radians(heading))) AS c FROM j JOIN q ON q.run = j.run AND q.k BETWEEN stop AND stop + wide GROUP BY ALL),
    i AS (SELECT j.run, g, sum(abs(rate) * k) FILTER (WHERE k BETWEEN first AND last) / sum(abs(rate)) FILTER (WHERE k BETWEEN first AND last) AS middle, coalesce(sum(dist) FILTER (WHERE k < stop), 0) AS support, max(abs(curvature)) FILTER (WHERE k BETWEEN first AND last) AS peak FROM j JOIN q ON q.run = j.run AND q.k BETWEEN start AND stop GROUP BY ALL),
    o AS (SELECT j.*, {_wrap('degrees(atan2(m1.s, m1.c)) - degrees(atan2(m0.s, m0.c))')} AS angle, middle, support, peak FROM j JOIN m0 USING (run, g) JOIN m1 USING (run, g) JOIN i USING (run, g) WHERE sqrt(m0.s * m0.s + m0.c * m0.c) > 1e-8 AND sqrt(m1.s * m1.s + m1.c * m1.c) > 1e-8)
    SELECT run, first, last, sign::INT AS sign, start, stop, round(angle, 4) + 0.0 AS angle, least(n - 1, round(middle)::BIGINT + 1) AS centre, round(support, 4) + 0.0 AS support, round(peak, 4) + 0.0 AS peak_curvature FROM o WHERE abs(angle) >= {turns.LEAST_ANGLE} AND sign(angle) = sign"""


@query("traj_turn_sessions", SESSIONS)
def turn_sessions(spark, d):
    found, _ = turns.sessions(ops.heading(trajectory(spark, d)).filter("heading is not null"))
    return _r(found.select("run", "first", "last", "sign", "start", "stop", "angle", "centre", "support", "peak_curvature"))


def _camera_route(spark, d):
    """Every user's events as a walk that bends every 30 rows, by a third of what its camera turns, and the camera's poses."""
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).select("run", "t", "id", (F.row_number().over(w) - 1).cast("long").alias("k"), (F.col("x") / 4000).alias("noise"), (F.col("y") / 100).alias("conf"))
    bend = F.floor(F.col("k") / 30) % 2
    rows = rows.withColumns({"yaw": bend * 0.5 + F.col("noise"), "cam": bend * 1.4 + F.col("noise")})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"x": F.sum(F.cos("yaw")).over(upto), "y": F.sum(F.sin("yaw")).over(upto)})


@query("traj_camera_turns")
def camera_turns(spark, d):
    """Turns of the walks, where the camera shows more of a bend than the path does."""
    rows = _camera_route(spark, d)
    z, x = (F.cos("cam"), F.sin("cam"), F.lit(0.0)), (F.sin("cam"), -F.cos("cam"), F.lit(0.0))
    rotations = rows.select("run", "k", F.array(x[0], F.lit(0.0), z[0], x[1], F.lit(0.0), z[1], x[2], F.lit(-1.0), z[2]).alias("rotation"))
    one = lambda *v: [F.lit(float(k)) for k in v]
    basis = rows.select("run").distinct().select("run", *[v.alias(p + a) for p, vs in (("x", one(1, 0, 0)), ("y", one(0, 1, 0)), ("n", one(0, 0, 1))) for a, v in zip("xyz", vs, strict=True)])
    found, rated = turns.sessions(ops.adaptive_heading(rows.select("run", "t", "id", "x", "y")))
    camera, axes = turns.camera_heading(rated, rotations, basis)
    return _r(turns.reported(turns.observed(found, camera, axes), rated, rows.select("run", "k", "conf")), 3)


@query("floor_from_turns")
def floor_from_turns(spark, d):
    """Floors of the walks as a camera sees them that looks down and leans."""
    rows = _camera_route(spark, d)
    # The camera's axes in a world that is turned about x by 0.3; the camera itself looks down by 0.5.
    c, s = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    lean = lambda v: (v[0], c * v[1] - s * v[2], s * v[1] + c * v[2])
    a, b = F.cos(F.lit(0.5)), F.sin(F.lit(0.5))
    forward, right, down = (F.cos("cam"), F.sin("cam"), F.lit(0.0)), (F.sin("cam"), -F.cos("cam"), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    z = lean(tuple(a * f + b * q for f, q in zip(forward, down, strict=True)))
    y = lean(tuple(a * q - b * f for f, q in zip(forward, down, strict=True)))
    x, at = lean(right), lean((F.col("x"), F.col("y"), F.lit(0.0)))
    pose = F.array(*[e for r in range(3) for e in (x[r], y[r], z[r], at[r])], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))
    poses = rows.select("run", F.col("k").alias("frame"), pose.alias("pose"))
    basis = gravity.floors(poses)
    return _r(gravity.on_floor(poses, basis).join(basis.select("run", "method", "nx", "ny", "nz"), "run"), 4)


@query("odometry_steps")
def odometry_steps(spark, d):
    """Steps of two sources from the events' numbers; every seventh row has one source, every fiftieth an outlier."""
    k = F.row_number().over(Window.partitionBy("run").orderBy("t", "id"))
    rows = trajectory(spark, d).select("run", "id", (F.col("t") / 3600).alias("t"), (F.col("x") / 500).alias("dx"), (F.col("y") / 2000).alias("dy"), ((F.col("y") - 50) / 10).alias("turn"), (F.col("x") % 10 / 10).alias("conf"), (F.col("y") % 10 / 10).alias("conf2"), k.alias("k"))
    wild = F.when(F.col("k") % 50 == 0, 40.0).otherwise(0.0)
    rows = rows.withColumns({"turn": F.col("turn") + wild, "dx2": F.when(F.col("k") % 7 > 0, F.col("dx") * 1.1), "dy2": F.col("dy"), "turn2": F.col("turn") + wild})
    return _r(odometry.integrated(rows).select("run", "id", "x", "y", "heading", "source", "gated", "state"), 5)
