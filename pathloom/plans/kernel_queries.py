"""Queries of repairs, sequential kernels, alignment, routing and pose graphs.

Most of them carry decisions from row to row, which SQL can't say; the tests
hold these against plain versions.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, calibration, hypotheses, kernels, posegraph, repair, routing, trellis
from ..operators import series as s
from ..operators.joins import dealt, merged
from ..sources.shared import stored
from .bindings import TRAJ, cloud, table, trajectory
from .catalog import query
from .series_queries import STEPS, W


def _r(df, digits=4):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _walk(spark, d):
    """Every run as a walk: positions are running sums of the events' numbers."""
    w = Window.partitionBy("run").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return dealt(trajectory(spark, d), "run").select("run", "t", "id", "kind", F.sum(F.col("x") / 50 - F.col("id") % 3 / 4).over(w).alias("x"), F.sum(F.col("y") / 50 - 0.5).over(w).alias("y"), (F.col("y") % 10).alias("conf"))


def _drive(spark, d):
    """Every run as a drive that winds smoothly: its direction swings, with a little noise."""
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).select("run", "t", "id", (F.row_number().over(w) - 1).alias("k"), (F.col("x") / 5000).alias("noise")).withColumn("turn", 2 * F.sin(F.col("k") / 9) + F.col("noise"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("run", "t", "id", F.sum(F.cos("turn")).over(upto).alias("x"), F.sum(F.sin("turn")).over(upto).alias("y"))


_HELD = f"{STEPS}, m AS (SELECT run, quantile_cont(step, 0.5) FILTER (WHERE step > 1e-9) AS med, count(*) AS n FROM steps GROUP BY run), d AS (SELECT s.run, quantile_cont(abs(step - med), 0.5) FILTER (WHERE step > 1e-9) AS mad FROM steps s JOIN m USING (run) GROUP BY s.run)"


@query(
    "traj_teleports_held",
    f"""WITH {_HELD}, k AS (SELECT s.run, s.id, s.t, n, CASE WHEN coalesce(step > greatest(8 * med, med + 6 * mad, 1e-6), false) AND n >= 5 THEN NULL ELSE x END AS hx, CASE WHEN coalesce(step > greatest(8 * med, med + 6 * mad, 1e-6), false) AND n >= 5 THEN NULL ELSE y END AS hy FROM steps s JOIN m USING (run) JOIN d USING (run)),
    h AS (SELECT run, id, t, n, CASE WHEN n >= 9 THEN 4 WHEN n >= 7 THEN 3 WHEN n >= 5 THEN 2 ELSE 0 END AS half, row_number() OVER w AS k, last_value(hx IGNORE NULLS) OVER w AS x, last_value(hy IGNORE NULLS) OVER w AS y FROM k WINDOW w AS (PARTITION BY run ORDER BY t, id ROWS UNBOUNDED PRECEDING)),
    o AS (SELECT run, id, k, x, y, n, half, unnest(range(-half, half + 1)) AS o FROM h),
    e AS (SELECT o.run, o.id, o.k, avg(h.x) AS mx, avg(h.y) AS my FROM o JOIN h ON h.run = o.run AND h.k = greatest(1, least(o.n, o.k + o.o)) GROUP BY o.run, o.id, o.k),
    f AS (SELECT e.run, mx AS fx, my AS fy, h.x AS x0, h.y AS y0 FROM e JOIN h ON h.run = e.run AND h.k = 1 WHERE e.k = 1)
    SELECT e.run, e.id, round(mx - fx + x0, 4) + 0.0 AS x, round(my - fy + y0, 4) + 0.0 AS y FROM e JOIN f USING (run)""",
)
def teleports(spark, d):
    return _r(repair.teleports_held(trajectory(spark, d)).select("run", "id", "x", "y"))


@query("traj_cleaned")
def traj_cleaned(spark, d):
    return _r(repair.cleaned(_walk(spark, d), "conf").select("run", "id", "x", "y", "outlier"), 6)


@query("traj_clipped_smooth")
def clipped_smooth(spark, d):
    return _r(repair.clipped_and_smoothed(trajectory(spark, d)).select("run", "id", "x", "y"), 6)


@query("traj_stabilised")
def stabilised(spark, d):
    return _r(repair.stabilised(_walk(spark, d)).select("run", "id", "x", "y", "stable"), 6)


@query("traj_trend_window")
def trend_window(spark, d):
    blocks = s.block_medians(trajectory(spark, d), 30.0 * 3600).withColumnsRenamed({"block": "t"}).withColumn("id", F.col("t"))
    return _r(repair.trend_window(blocks).select("run", "t", "x", "y", "window"), 6)


@query("traj_adaptive_heading")
def adaptive(spark, d):
    return _r(s.adaptive_heading(trajectory(spark, d)).select("run", "id", "heading"))


@query("traj_chord_turns")
def chord_turns(spark, d):
    return _r(s.chord_turns(_drive(spark, d), window=12, gap=5), 3)


@query("traj_hysteresis_turns")
def hysteresis(spark, d):
    """Every twenty rows a turn over five of them, to either side in turn; between them the direction trembles."""
    k = F.row_number().over(Window.partitionBy("run").orderBy("t", "id")) - 1
    turn = F.when(F.floor(k / 20) % 2 == 0, 9.0).otherwise(-7.0)
    rows = trajectory(spark, d).select("run", "t", "id", F.when(k % 20 < 5, turn).otherwise(F.col("x") / 1000 - 0.05).alias("rate"), F.lit(1.0).alias("speed"))
    return _r(kernels.hysteresis_turns(rows, "rate", "speed"), 3)


@query("traj_kalman")
def kalman(spark, d):
    return _r(kernels.kalman(trajectory(spark, d).withColumn("t", F.col("t") / 3600)), 5)


@query("traj_motion_states")
def motion_states(spark, d):
    rows = trajectory(spark, d).select("run", "t", "id", (F.col("x") / 1000).alias("move"), (F.col("y") / 20).alias("turn"), (F.col("x") / 200).alias("flow"), (F.col("x") % 7 / 20).alias("conf"), (F.col("id") % 4 > 0).alias("posed"))
    return kernels.motion_states(rows)


@query("detection_tracks")
def tracks(spark, d):
    rows = trajectory(spark, d).select("run", F.floor(F.col("t") / 43200).cast("double").alias("t"), "id", (F.col("x") / 10).alias("x1"), (F.col("y") / 10).alias("y1"))
    return kernels.tracked(rows.withColumns({"x2": F.col("x1") + 8, "y2": F.col("y1") + 8}))


@query("box_suppression")
def suppression(spark, d):
    rows = cloud(spark, d).select(F.floor(F.col("pid") / 40).alias("frame"), F.col("pid").alias("id"), F.col("conf").alias("score"), (F.col("x") * 10).alias("x1"), (F.col("y") * 10).alias("y1"))
    return kernels.suppressed(rows.withColumns({"x2": F.col("x1") + 3, "y2": F.col("y1") + 3}), 0.3)


@query("traj_simplified")
def simplified(spark, d):
    return _r(kernels.simplified(_drive(spark, d), 1.5))


@query("traj_map_turns")
def map_turns(spark, d):
    return _r(kernels.map_turns(_drive(spark, d), 1.5), 3)


def _quality_steps(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return calibration.isotonic(rows.select("lang", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("score"), "quality"), "lang", "score", "quality")


@query("isotonic_calibration")
def isotonic(spark, d):
    return _r(_quality_steps(spark, d), 6)


@query("isotonic_scores")
def isotonic_scores(spark, d):
    """Every document's calibrated probability."""
    docs = table(spark, d, "documents").select("doc_id", "lang", F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("score"))
    return _r(calibration.calibrated(docs, _quality_steps(spark, d), "lang", "score").drop("score"), 6)


@query("traj_scale_regimes")
def scale_regimes(spark, d):
    """Cuts at every 20th row; from the 20th on, steps are three times as long."""
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).withColumn("k", F.row_number().over(w) - 1)
    big = rows.withColumns({"x": F.col("x") * F.when(F.col("k") >= 20, 3).otherwise(1), "t": F.col("k").cast("double")})
    return _r(kernels.regimes(big, rows.filter("k > 0 and k % 20 = 0").select("run", "k")), 5)


@query("traj_straightened")
def straightened(spark, d):
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).withColumn("k", F.row_number().over(w) - 1).select("run", "t", "id", F.col("k").cast("double").alias("x"), (F.col("y") / 500 + F.when(F.col("k") > 40, F.col("k") - 40).otherwise(0)).alias("y"), "k")
    return _r(kernels.straightened(rows, rows.filter("k = 40").select("run", (F.col("k") - 3).alias("first"), (F.col("k") + 3).alias("last"))), 5)


@query("traj_curvature_anchors")
def curvature_anchors(spark, d):
    return _r(kernels.anchors(_walk(spark, d), 2.0, 24), 6)


@query("traj_scale_curve")
def scale_curve(spark, d):
    rows = _walk(spark, d).withColumns({"height": F.when(F.col("id") % 3 == 0, 1.5 + F.col("conf") / 20), "weight": F.lit(1.0)})
    return _r(kernels.scale_curve(rows, "height", "weight"), 5)


@query("turn_topology")
def turn_topology(spark, d):
    rows = trajectory(spark, d)
    events = rows.filter("kind = 'purchase'").select("run", F.col("id").alias("l"), (F.col("t") / 2e6).alias("at"), (F.col("x") - 50).alias("angle"))
    other = rows.filter("kind = 'click'").select("run", F.col("id").alias("r"), (F.col("t") / 2e6).alias("r_at"), (F.col("y") - 50).alias("r_angle"))
    bucket = lambda c: F.floor(F.col(c) / 0.12)
    near = events.select("run", "l", "at", F.explode(F.array(bucket("at") - 1, bucket("at"), bucket("at") + 1)).alias("b")).join(other.withColumn("b", bucket("r_at")), ["run", "b"]).filter("abs(at - r_at) <= 0.12")
    return _r(kernels.ordered_matches(near.select("run", "l", "r", "r_at", "r_angle"), events), 3)


@query("rotation_projection")
def rotation_projection(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.slice(F.transform("embedding", lambda v: v.cast("double")), 1, 9).alias("m"))
    return rows.select("vec_id", F.transform(alignment.projected_rotation("m"), lambda v: F.round(v, 6) + 0.0).alias("rotation"))


@query("motion_plane")
def motion_plane(spark, d):
    return _r(alignment.motion_plane(cloud(spark, d).select("frame", "pid", "x", "y", "z"), "frame", ["pid"]), 6)


@query(
    "floor_basis",
    f"""WITH {TRAJ}, h AS (SELECT run, avg(x) AS hx, avg(y) + 1 AS hz, 0.5 AS hy FROM traj GROUP BY run), n AS (SELECT *, run % 3 = 0 AS bad FROM h),
    c AS (SELECT run, hx, hy, hz, CASE WHEN bad THEN 0.0 ELSE 0.6::DOUBLE END AS nx, CASE WHEN bad THEN -1.0 ELSE 0.8::DOUBLE END AS ny, 0.0::DOUBLE AS nz FROM n),
    f AS (SELECT run, nx, ny, nz, hx - (hx*nx + hy*ny + hz*nz) * nx AS gx, hy - (hx*nx + hy*ny + hz*nz) * ny AS gy, hz - (hx*nx + hy*ny + hz*nz) * nz AS gz FROM c), u AS (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS l FROM f)
    SELECT run, round(gx / l, 5) + 0.0 AS xx, round(gy / l, 5) + 0.0 AS xy, round(gz / l, 5) + 0.0 AS xz, round((ny * gz - nz * gy) / l, 5) + 0.0 AS yx, round((nz * gx - nx * gz) / l, 5) + 0.0 AS yy, round((nx * gy - ny * gx) / l, 5) + 0.0 AS yz, nx, ny, nz FROM u""",
)
def floor_basis(spark, d):
    heads = trajectory(spark, d).groupBy("run").agg(F.avg("x").alias("hx"), (F.avg("y") + 1).alias("hz")).withColumn("hy", F.lit(0.5))
    normals = heads.select("run", F.lit(1).alias("priority"), F.lit(3.0).alias("nx"), F.lit(4.0).alias("ny"), F.lit(0.0).alias("nz"), (F.col("run") % 3).cast("double").alias("support"), F.lit(0.55).alias("least"))
    return _r(alignment.floor_basis(normals, heads, "run"), 5)


@query("robust_similarity")
def robust_similarity(spark, d):
    c = cloud(spark, d)
    u, v = 2.4 * (0.8 * F.col("x") - 0.6 * F.col("y")) + 13, 2.4 * (0.6 * F.col("x") + 0.8 * F.col("y")) - 8
    pairs = c.select("frame", "x", "y", (u + F.when(F.col("pid") % 11 == 0, 9).otherwise(F.col("conf") / 100)).alias("u"), v.alias("v"))
    return _r(alignment.robust_similarity(pairs, "frame"), 5)


@query("two_source_fusion")
def fusion(spark, d):
    w = _walk(spark, d)
    turn = lambda a, b: 2.4 * (a * F.col("x") + b * F.col("y"))
    second = w.filter("id % 2 = 0").select("run", "id", "t", (turn(0.86, -0.52) + 13 + F.col("conf") / 50).alias("x"), (turn(0.52, 0.86) - 8).alias("y"))
    return _r(alignment.fused(w.select("run", "id", "t", "x", "y"), second, "run", "t", "id")[0].select("run", "id", "x", "y", "accepted"), 5)


@query("floor_planes")
def floor_planes(spark, d):
    """Each frame's vectors as a floor 1.6 below the camera, with some off it."""
    c = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "v"))
    points = c.select(F.col("label").alias("frame"), (F.col("vec_id") * 64 + F.col("k")).alias("id"), (F.col("k") % 8 - 3.5 + F.col("v").cast("double")).alias("x"), (1.6 + F.col("v").cast("double") * F.when(F.col("k") % 5 == 0, 3).otherwise(0.01)).alias("y"), (F.floor(F.col("k") / 8) + 1 + F.col("v").cast("double")).alias("z"))
    return _r(alignment.floor_planes(points, (0.0, 1.0, 0.0)), 5)


def _routes(rows):
    """Positions of true and drifting poses, the drifting poses, and edges 1, 2 and 5 frames apart as the true ones have them; rows: run, frame, a, b."""

    def pose(turn, x, z):
        return F.array(F.cos(turn), F.lit(0.0), F.sin(turn), x, F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), -F.sin(turn), F.lit(0.0), F.cos(turn), z, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    k = F.col("frame")
    true = pose(k * 0.05, k * 0.3 + F.col("a") * 0.05, F.sin(k * 0.2))
    drift = pose(k * 0.055, k * 0.33 + F.col("b") * 0.2, F.sin(k * 0.2) + k * 0.02)
    places = rows.select("run", "frame", *[p[i].alias(f"{name}_{i}") for name, p in (("true", true), ("start", drift)) for i in (3, 7, 11)])
    true, drift = (rows.select("run", "frame", p.alias("pose")) for p in (true, drift))
    return places, drift, posegraph.relative(true, (1, 2, 5)).withColumn("weight", 1.0 / (F.col("j") - F.col("i")))


def _straightened_routes(rows):
    """Optimised positions, and how far a run was from its true ones before and is after."""
    rows = stored(rows, "routes")
    places, drift, edges = _routes(rows)
    out = posegraph.optimise(drift, edges).select("run", "frame", *[F.col("pose")[i].alias(c) for c, i in (("x", 3), ("y", 7), ("z", 11))], "accepted")
    both = stored(out.join(places, ["run", "frame"]), "positions")
    away = lambda ours, name: F.sqrt(F.avg(sum((F.col(c) - F.col(f"{name}_{i}")) ** 2 for c, i in zip(ours, (3, 7, 11), strict=True))))
    per = stored(both.groupBy("run").agg(away([f"start_{i}" for i in (3, 7, 11)], "true").alias("rmse_before"), away(["x", "y", "z"], "true").alias("rmse_after")), "away")
    return _r(both.join(per, "run").select("run", "frame", "x", "y", "z", "accepted", "rmse_before", "rmse_after"), 4)


@query("pose_graph_optimised")
def pose_graph(spark, d):
    """Every user's events as a camera path."""
    w = Window.partitionBy("run").orderBy("t", "id")
    return _straightened_routes(trajectory(spark, d).select("run", (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("x") / 100).alias("a"), (F.col("y") / 100).alias("b")))


@query("pose_graph_long_runs")
def pose_graph_long(spark, d):
    """All events of a kind as one camera path: runs of many blocks."""
    w = Window.partitionBy("kind").orderBy("t", "id")
    return _straightened_routes(trajectory(spark, d).select(F.col("kind").alias("run"), (F.row_number().over(w) - 1).cast("long").alias("frame"), (F.col("x") / 100).alias("a"), (F.col("y") / 100).alias("b")))


#: Cells of a plan, and users who share one.
WIDE, HIGH, USERS = 40, 20, 8
PLAN = f"""{TRAJ}, walked AS (SELECT DISTINCT run // {USERS} AS map, least({WIDE - 1}, floor(sqrt(x) * 2))::BIGINT AS cx, least({HIGH - 1}, floor(y / 5))::BIGINT AS cy FROM traj),
    near AS (SELECT DISTINCT map, cx + o AS cx, cy FROM walked, range(-1, 2) r(o)),
    plan AS (SELECT g.map, g.cx, g.cy, n.map IS NULL AS occupied FROM (SELECT DISTINCT map, a.cx, b.cy FROM walked, range({WIDE}) a(cx), range({HIGH}) b(cy)) g LEFT JOIN near n USING (map, cx, cy))"""


def _plan(spark, d):
    """One plan for each eight users: cells that none of them walked on or beside are occupied."""
    rows = trajectory(spark, d).select(F.expr(f"run div {USERS}").alias("map"), F.least(F.lit(WIDE - 1), F.floor(F.sqrt("x") * 2)).alias("cx"), F.least(F.lit(HIGH - 1), F.floor(F.col("y") / 5)).alias("cy")).distinct()
    near = rows.select("map", F.explode(F.array(F.col("cx") - 1, F.col("cx"), F.col("cx") + 1)).alias("cx"), "cy").distinct().withColumn("free", F.lit(True))
    cells = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = rows.select("map").distinct().select("map", cells(WIDE).alias("cx")).select("map", "cx", cells(HIGH).alias("cy"))
    return merged(grid).join(near, ["map", "cx", "cy"], "left").select("map", "cx", "cy", F.col("free").isNull().alias("occupied"))


@query("plan_clearance", f"WITH {PLAN} SELECT p.map, p.cx, p.cy, p.occupied, round(least(6, coalesce(min(sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2)), 6)), 6) + 0.0 AS clearance FROM plan p LEFT JOIN (SELECT * FROM plan WHERE occupied) q ON p.map = q.map GROUP BY ALL")
def plan_clearance(spark, d):
    return _r(routing.clearance(_plan(spark, d), 6), 6)


@query("plan_regions")
def plan_regions(spark, d):
    return routing.regions(_plan(spark, d), WIDE)


@query("plan_routes")
def plan_routes(spark, d):
    """For every user the way from the first place to the last."""
    seen = _on_plan(spark, d).select("map", "run", "k", F.floor("x").alias("cx"), F.floor("y").alias("cy"))
    ends = seen.groupBy("map", F.col("run").alias("id")).agg(F.min_by(F.struct("cx", "cy"), "k").alias("a"), F.max_by(F.struct("cx", "cy"), "k").alias("b"))
    return _r(routing.routes(ends.select("map", "id", F.col("a.cx").alias("x0"), F.col("a.cy").alias("y0"), F.col("b.cx").alias("x1"), F.col("b.cy").alias("y1")), routing.clearance(_plan(spark, d), 6)), 4)


def _on_plan(spark, d):
    """Every user's places, some of them off the walked cells."""
    w = trajectory(spark, d)
    return w.select(F.expr(f"run div {USERS}").alias("map"), "run", "id", F.row_number().over(Window.partitionBy("run").orderBy("t", "id")).cast("long").alias("k"), F.least(F.lit(WIDE - 0.5), F.sqrt("x") * 2 + F.col("id") % 3).alias("x"), (F.col("y") / 5).alias("y"), "kind")


@query("plan_matched_second_order")
def plan_matched_second(spark, d):
    return _r(trellis.matched(_on_plan(spark, d).select("map", "run", "k", "x", "y"), routing.clearance(_plan(spark, d), 6), 1.0), 5)


#: The search on the events: routes shrunk by 1.3 and turned by 20 degrees, sought on a lattice of these steps.
RATIO, DEGREES, WIDTH, STRIDES, SCALES, YAWS = 1.08, 5.0, 6, (4, 2, 1), 8, 8


def _beam_sql() -> str:
    score = (
        f"round({hypotheses.COLLISION} * avg(coalesce(occupied, true)::INT) + {hypotheses.OUTSIDE} * avg((occupied IS NULL)::INT) + {hypotheses.TIGHT} * avg(exp(-coalesce(clearance, 0) / {hypotheses.ROOM}::DOUBLE))"
        f" + {hypotheses.SPEED} * coalesce(ln(any_value(pace) * pow({RATIO}::DOUBLE, si)) ** 2, 0) + {hypotheses.YAW} * abs(yi) * {DEGREES}::DOUBLE / 5, 9)"
    )
    level = lambda k, hyps: f"""h{k} AS ({hyps}), s{k} AS (SELECT h.run, h.si, h.yi, map, pace, floor(sx + pow({RATIO}::DOUBLE, si) * (cos(radians({DEGREES}::DOUBLE) * yi) * dx - sin(radians({DEGREES}::DOUBLE) * yi) * dy)) AS cx, floor(sy + pow({RATIO}::DOUBLE, si) * (sin(radians({DEGREES}::DOUBLE) * yi) * dx + cos(radians({DEGREES}::DOUBLE) * yi) * dy)) AS cy FROM h{k} h JOIN samples USING (run)),
    c{k} AS (SELECT s.run, si, yi, {score} AS score, avg(coalesce(occupied, true)::INT) AS collision, avg((occupied IS NULL)::INT) AS outside FROM s{k} s LEFT JOIN room r ON s.map = r.map AND s.cx = r.cx AND s.cy = r.cy GROUP BY s.run, si, yi),
    b{k} AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score, abs(yi), yi, si) - 1 AS place FROM c{k} QUALIFY place < {WIDTH})"""  # noqa: E731
    first = f"SELECT run, si, yi FROM (SELECT DISTINCT run FROM samples), range({-SCALES}, {SCALES + 1}, {STRIDES[0]}) a(si), range({-YAWS}, {YAWS + 1}, {STRIDES[0]}) b(yi)"
    later = lambda k: f"SELECT DISTINCT run, si + {STRIDES[k]} * a AS si, yi + {STRIDES[k]} * b AS yi FROM b{k - 1}, range(-1, 2) x(a), range(-1, 2) y(b) WHERE abs(si + {STRIDES[k]} * a) <= {SCALES} AND abs(yi + {STRIDES[k]} * b) <= {YAWS}"
    levels = ", ".join(level(k, later(k) if k else first) for k in range(len(STRIDES)))
    return f"""WITH {PLAN}, room AS (SELECT p.map, p.cx, p.cy, p.occupied, least(6, coalesce(min(sqrt((p.cx - q.cx) ** 2 + (p.cy - q.cy) ** 2)), 6)) AS clearance FROM plan p LEFT JOIN (SELECT * FROM plan WHERE occupied) q ON p.map = q.map GROUP BY ALL),
    seen AS (SELECT run // {USERS} AS map, run, least({WIDE - 0.5}, sqrt(x) * 2 + id % 3) AS x, y / 5 AS y, row_number() OVER (PARTITION BY run ORDER BY t, id) AS k FROM traj),
    samples AS (SELECT s.map, s.run, (0.75 * (s.x - f.x) - 0.28 * (s.y - f.y)) AS dx, (0.28 * (s.x - f.x) + 0.75 * (s.y - f.y)) AS dy, f.x AS sx, f.y AS sy, CASE WHEN s.run % 2 = 0 THEN 0.8::DOUBLE END AS pace FROM seen s JOIN seen f ON f.run = s.run AND f.k = 1),
    {levels}, o AS (SELECT *, lead(score) OVER (PARTITION BY run ORDER BY place) - score AS margin FROM b{len(STRIDES) - 1})
    SELECT run, place, round(score, 5) + 0.0 AS score, si::BIGINT AS scale_step, yi::BIGINT AS yaw_step, round(collision, 5) + 0.0 AS collision, round(outside, 5) + 0.0 AS outside, round(margin, 5) + 0.0 AS margin FROM o"""


@query("hypothesis_beam", _beam_sql())
def hypothesis_beam(spark, d):
    seen = _on_plan(spark, d).select("map", "run", "k", "x", "y")
    first = seen.filter("k = 1").select("run", F.col("x").alias("sx"), F.col("y").alias("sy"))
    x, y = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    samples = seen.join(first, "run").select("map", "run", (0.75 * x - 0.28 * y).alias("dx"), (0.28 * x + 0.75 * y).alias("dy"), "sx", "sy", F.lit(0.0).alias("turn"), F.lit(1.0).alias("base"), F.when(F.col("run") % 2 == 0, 0.8).alias("pace"))
    found = hypotheses.searched(samples, routing.clearance(_plan(spark, d), 6), WIDTH, STRIDES, SCALES, YAWS, RATIO, DEGREES)
    return _r(found.withColumns({c: F.col(c).cast("long") for c in ("place", "scale_step", "yaw_step")}), 5)


@query("plan_rerouted")
def plan_rerouted(spark, d):
    return _r(routing.rerouted(_on_plan(spark, d).select("map", "run", "k", "x", "y"), routing.clearance(_plan(spark, d), 6), 1.0, "run", "k"), 4)


@query("plan_matched")
def plan_matched(spark, d):
    seen = _on_plan(spark, d)
    near = F.explode(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("o")
    at = seen.withColumns({"cx": F.floor("x"), "cy": F.floor("y")}).select("map", "run", "k", "cx", "cy", near).withColumns({"cx": F.col("cx") + F.col("o.dx"), "cy": F.col("cy") + F.col("o.dy")})
    free = merged(at).join(_plan(spark, d).filter("not occupied"), ["map", "cx", "cy"]).select("run", "k", "cx", "cy", (F.col("cx") + 0.5).alias("wx"), (F.col("cy") + 0.5).alias("wy"))
    return routing.matched(seen, free)


@query("plan_loops_closed")
def loops(spark, d):
    rows = _on_plan(spark, d).select("run", "k", F.floor("x").alias("cx"), F.floor("y").alias("cy"), (F.col("k") * 40.0).alias("heading"), F.when(F.col("k") % 4 == 0, F.col("kind")).alias("kind"))
    return routing.loops_closed(rows)


@query("plan_snapped")
def plan_snapped(spark, d):
    return _r(routing.snapped(_on_plan(spark, d).select("map", "run", "k", "x", "y"), routing.clearance(_plan(spark, d), 6), 1.0, ["run", "k"]), 4)


@query("plan_drawn", "WITH s AS (SELECT n_nationkey AS map, n_nationkey % 9 * 3.0 AS x0, n_regionkey * 5.0 AS y0 FROM nation) SELECT map::BIGINT AS map, cx::BIGINT AS cx, cy::BIGINT AS cy FROM s, range(0, 20) a(cx), range(0, 20) b(cy) WHERE cx BETWEEN floor(x0 / 2) AND floor((x0 + 5) / 2) AND cy BETWEEN floor(y0 / 2) AND floor((y0 + 3) / 2)")
def plan_drawn(spark, d):
    shapes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("map"), F.lit("rect").alias("kind"), (F.col("n_nationkey") % 9 * 3.0).alias("x0"), (F.col("n_regionkey") * 5.0).alias("y0"))
    return routing.drawn(shapes.withColumns({"x1": F.col("x0") + 5, "y1": F.col("y0") + 3}), 2.0)
