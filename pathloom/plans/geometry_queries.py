"""Geometry, graph and plan-grid queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, plan, stats
from .bindings import CLOUD, EDGES, TRAJ, cloud, edges, table, trajectory
from .catalog import query
from .series_queries import STEPS, W


def _r(df, digits=4):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_N = "sqrt(x*x + y*y + z*z + r*r)"
_Q = f"{CLOUD}, q AS (SELECT pid, x / {_N} AS x, y / {_N} AS y, z / {_N} AS z, r / {_N} AS w FROM cloud)"
_MAT = "1 - 2*(y*y + z*z) AS r00, 2*(x*y - z*w) AS r01, 2*(x*z + y*w) AS r02, 2*(x*y + z*w) AS r10, 1 - 2*(x*x + z*z) AS r11, 2*(y*z - x*w) AS r12, 2*(x*z - y*w) AS r20, 2*(y*z + x*w) AS r21, 1 - 2*(x*x + y*y) AS r22"
_NAMES = [f"r{i}{j}" for i in range(3) for j in range(3)]


def _matrices(spark, d):
    rows = cloud(spark, d)
    return rows.withColumns(g.quaternion_matrix(F.col("x"), F.col("y"), F.col("z"), F.col("r"))).withColumns({"tx": F.col("g"), "ty": F.col("b"), "tz": F.col("conf")})


@query("angle_wrap", f"WITH {TRAJ} SELECT id, round(180.0::DOUBLE - ((180.0::DOUBLE - (x * 9 - y * 7)) - 360.0::DOUBLE * floor((180.0::DOUBLE - (x * 9 - y * 7)) / 360.0::DOUBLE)), 4) + 0.0 AS deg FROM traj")
def angle_wrap(spark, d):
    return _r(trajectory(spark, d).select("id", g.wrap_degrees(F.col("x") * 9 - F.col("y") * 7).alias("deg")))


@query("quaternion_matrix", f"WITH {_Q} SELECT pid, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _NAMES)} FROM (SELECT pid, {_MAT} FROM q)")
def quaternion_matrix(spark, d):
    return _r(_matrices(spark, d).select("pid", *_NAMES), 6)


#: The predicate of a valid rotation in SQL: bounds of the entries, orthonormality, determinant.
_DOT = lambda i, j: f"pow(r0{i} * r0{j} + r1{i} * r1{j} + r2{i} * r2{j} - {int(i == j)}, 2)"
_VALID = (
    " AND ".join(f"abs({n}) <= 1.5" for n in _NAMES)
    + f" AND sqrt({' + '.join(_DOT(i, j) for i in range(3) for j in range(3))}) <= 0.08"
    + " AND r00 * (r11 * r22 - r12 * r21) - r01 * (r10 * r22 - r12 * r20) + r02 * (r10 * r21 - r11 * r20) BETWEEN 0.85 AND 1.15"
)


@query("rotation_validity", f"WITH {_Q}, m AS (SELECT pid, {_MAT} FROM q), bent AS (SELECT * REPLACE (r00 + (pid % 7) * 0.03::DOUBLE AS r00) FROM m) SELECT pid, {_VALID} AS valid FROM bent")
def rotation_validity(spark, d):
    rows = _matrices(spark, d).withColumn("r00", F.col("r00") + (F.col("pid") % 7) * 0.03)
    return rows.select("pid", g.valid_rotation().alias("valid"))


@query("rigid_inverse", f"WITH {CLOUD}, q AS (SELECT pid, x / {_N} AS x, y / {_N} AS y, z / {_N} AS z, r / {_N} AS w, g AS tx, b AS ty, conf AS tz FROM cloud), m AS (SELECT pid, tx, ty, tz, {_MAT} FROM q) SELECT pid, round(-(r00*tx + r10*ty + r20*tz), 6) + 0.0 AS tx, round(-(r01*tx + r11*ty + r21*tz), 6) + 0.0 AS ty, round(-(r02*tx + r12*ty + r22*tz), 6) + 0.0 AS tz, round(r10, 6) + 0.0 AS r01 FROM m")
def rigid_inverse(spark, d):
    rows = _matrices(spark, d)
    return _r(rows.select("pid", *[c.alias(n) for n, c in g.inverse_rigid().items()]).select("pid", "tx", "ty", "tz", "r01"), 6)


@query("plane_similarity", f"WITH {TRAJ} SELECT id, round(2.5::DOUBLE * (cos(radians(31)) * x - sin(radians(31)) * y) + 13, 4) AS px, round(2.5::DOUBLE * (sin(radians(31)) * x + cos(radians(31)) * y) - 8, 4) AS py FROM traj")
def plane_similarity(spark, d):
    px, py = g.similarity(F.col("x"), F.col("y"), F.lit(31.0), F.lit(2.5), F.lit(13.0), F.lit(-8.0))
    return _r(trajectory(spark, d).select("id", px.alias("px"), py.alias("py")))


@query("unit_vectors", f"WITH {CLOUD} SELECT pid, round(x / sqrt(x*x + y*y + z*z), 6) AS ux, round(y / sqrt(x*x + y*y + z*z), 6) AS uy, round(z / sqrt(x*x + y*y + z*z), 6) AS uz FROM cloud")
def unit_vectors(spark, d):
    ux, uy, uz = g.unit_vector(F.col("x"), F.col("y"), F.col("z"))
    return cloud(spark, d).select("pid", ux.alias("ux"), uy.alias("uy"), uz.alias("uz"))


@query("snap_angles", f"WITH {TRAJ}, a AS (SELECT id, x * 3.7::DOUBLE - 180 AS a FROM traj) SELECT id, round(CASE WHEN abs(abs(a) - 45) <= 12 THEN sign(a) * 45 WHEN abs(abs(a) - 90) <= 12 THEN sign(a) * 90 WHEN abs(abs(a) - 135) <= 12 THEN sign(a) * 135 WHEN abs(abs(a) - 180) <= 12 THEN sign(a) * 180 ELSE a END, 4) + 0.0 AS angle FROM a")
def snap_angles(spark, d):
    return _r(trajectory(spark, d).select("id", g.snapped_angle(F.col("x") * 3.7 - 180).alias("angle")))


@query("grid_quantise", f"WITH {TRAJ} SELECT id, greatest(0, least(15, floor(x / 4)))::BIGINT AS cx, greatest(0, least(15, floor(y / 4)))::BIGINT AS cy, (greatest(0, least(15, floor(x / 4))) + 0.5) * 4.0::DOUBLE AS mx FROM traj")
def grid_quantise(spark, d):
    cx = g.grid_cell(F.col("x"), 4.0, 16)
    return trajectory(spark, d).select("id", cx.alias("cx"), g.grid_cell(F.col("y"), 4.0, 16).alias("cy"), g.cell_centre(cx, 4.0).alias("mx"))


@query("letterbox_points", f"WITH {TRAJ}, k AS (SELECT id, x, y, 1000.0::DOUBLE + id % 500 AS w, 700.0::DOUBLE AS h FROM traj), s AS (SELECT *, least(800 / w, 600 / h) AS k FROM k) SELECT id, round((x - (800 - w * k) / 2) / k, 8) + 0.0 AS ix, round((y - (600 - h * k) / 2) / k, 8) + 0.0 AS iy FROM s")
def letterbox_points(spark, d):
    ix, iy = g.letterbox(F.col("x"), F.col("y"), 1000.0 + F.col("id") % 500, F.lit(700.0))
    return _r(trajectory(spark, d).select("id", ix.alias("ix"), iy.alias("iy")), 8)


@query("box_iou", f"WITH {TRAJ}, b AS (SELECT id, x AS a0, y AS a1, x + 20 AS a2, y + 30 AS a3, x + 5 AS b0, y * 1.05::DOUBLE AS b1, x + 30 AS b2, y + 25 AS b3 FROM traj), i AS (SELECT *, greatest(0, least(a2, b2) - greatest(a0, b0)) * greatest(0, least(a3, b3) - greatest(a1, b1)) AS inter FROM b) SELECT id, round(coalesce(inter / nullif((a2 - a0) * (a3 - a1) + (b2 - b0) * (b3 - b1) - inter, 0), 0), 6) + 0.0 AS iou FROM i")
def box_iou(spark, d):
    x, y = F.col("x"), F.col("y")
    return _r(trajectory(spark, d).select("id", g.box_overlap((x, y, x + 20, y + 30), (x + 5, y * 1.05, x + 30, y + 25)).alias("iou")), 6)


@query("speed_prior_penalty", f"WITH {TRAJ}, q AS (SELECT id, (x + 1) / 30.0::DOUBLE AS q FROM traj) SELECT id, round(CASE WHEN q < 0.72 THEN pow(ln(q / 0.72), 2) WHEN q > 1.8 THEN pow(ln(q / 1.8), 2) ELSE 0 END + CASE WHEN q < 0.3 OR q > 2.7 THEN 4 ELSE 0 END, 5) AS penalty FROM q")
def speed_prior(spark, d):
    return _r(trajectory(spark, d).select("id", g.speed_penalty((F.col("x") + 1) / 30.0).alias("penalty")), 5)


@query("duration_samples", f"WITH {TRAJ}, s AS (SELECT run, max(t) - min(t) AS sec FROM traj GROUP BY run) SELECT run, CASE WHEN sec / 3000 <= 60 THEN 40 WHEN sec / 3000 <= 180 THEN 55 WHEN sec / 3000 <= 600 THEN 70 ELSE 90 END AS samples FROM s")
def duration_samples(spark, d):
    return trajectory(spark, d).groupBy("run").agg(((F.max("t") - F.min("t")) / 3000).alias("s")).select("run", g.sample_count(F.col("s")).alias("samples"))


@query("manual_percent_rescale", f"WITH {TRAJ}, m AS (SELECT run, max(x) AS top FROM traj GROUP BY run) SELECT id, round(CASE WHEN top <= 100.5 THEN x * 8 ELSE x END, 4) AS px FROM traj JOIN m USING (run)")
def percent_rescale(spark, d):
    rows = trajectory(spark, d)
    top = rows.groupBy("run").agg(F.max("x").alias("top"))
    return _r(rows.join(top, "run").select("id", g.display_percent(F.col("x"), F.col("top")).alias("px")))


@query("video_time_index", f"WITH {TRAJ}, s AS (SELECT run, min(t) AS a, max(t) AS b, count(*) AS n FROM traj GROUP BY run) SELECT id, greatest(0, least(n - 1, floor((t - a) / nullif(b - a, 0) * n)))::BIGINT AS idx FROM traj JOIN s USING (run)")
def time_index(spark, d):
    rows = trajectory(spark, d)
    span = rows.groupBy("run").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("n"))
    share = (F.col("t") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0.0))
    return rows.join(span, "run").select("id", F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(share * F.col("n")))).alias("idx"))


def _order_links(spark, d):
    """Every order with its customer, the customers as negative nodes."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("i"), (-1 - F.col("o_custkey")).alias("j"))


@query("edge_components", "SELECT o_orderkey AS node, -1 - o_custkey AS component FROM orders UNION SELECT -1 - o_custkey, -1 - o_custkey FROM orders")
def edge_components(spark, d):
    return graph.components(_order_links(spark, d))


@query("edge_component_summary", "WITH n AS (SELECT c_custkey, count(o_orderkey) + 1 AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS coverage FROM n")
def component_summary(spark, d):
    nodes = _order_links(spark, d).select(F.col("i").alias("node")).union(table(spark, d, "customer").select(-1 - F.col("c_custkey")))
    return _r(graph.component_summary(_order_links(spark, d), nodes), 6)


_LABELS = "s AS (SELECT i AS a, j AS b FROM edges UNION SELECT j, i FROM edges UNION SELECT p_partkey, p_partkey FROM part UNION SELECT s_suppkey, s_suppkey FROM supplier), r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, min(r.c) FROM r JOIN s ON r.node = s.a GROUP BY s.b), c AS (SELECT node, min(c) AS component FROM r GROUP BY node)"


@query("edge_components_whole", f"WITH RECURSIVE {EDGES}, {_LABELS} SELECT node, component FROM c WHERE node IN (SELECT i FROM edges UNION SELECT j FROM edges)")
def edge_components_whole(spark, d):
    return graph.components(edges(spark, d).select("i", "j"))


@query("edge_component_summary_whole", f"WITH RECURSIVE {EDGES}, {_LABELS}, n AS (SELECT component, count(*) AS n FROM c GROUP BY component) SELECT count(*) AS components, max(n) AS largest, round(max(n) / sum(n), 6) AS coverage FROM n")
def component_summary_whole(spark, d):
    links = edges(spark, d).select("i", "j")
    ends = [table(spark, d, "part").select("p_partkey"), table(spark, d, "supplier").select("s_suppkey"), links.select("i"), links.select("j")]
    nodes = reduce(DataFrame.union, ends).toDF("node")
    return _r(graph.component_summary(links, nodes), 6)


_READY = f"""WITH RECURSIVE {EDGES}, size AS (SELECT count(*) AS frames FROM part), e AS (SELECT i - 2 AS i, j - 2 AS j, etype, CASE WHEN eid % 31 > 0 THEN conf_t END AS conf_t, conf_r - 0.9::DOUBLE * (eid % 13 = 0)::INT AS conf_r, conf, eid % 41 > 0 AS posed, conf / 10 AS dx, CASE WHEN eid % 97 = 0 THEN 1.2::DOUBLE ELSE 1 END AS turn FROM edges),
    k AS (SELECT *, i < 0 OR j < 0 AS negative, i = j AS same, i >= frames OR j >= frames AS far FROM e, size), g AS (SELECT *, NOT negative AND NOT same AND NOT far AS good FROM k),
    s AS (SELECT i AS a, j AS b FROM g WHERE good UNION SELECT j, i FROM g WHERE good UNION SELECT r.v, r.v FROM size, LATERAL (SELECT unnest(range(frames)) AS v) r), r AS (SELECT a AS node, a AS c FROM s UNION SELECT s.b, min(r.c) FROM r JOIN s ON r.node = s.a GROUP BY s.b),
    c AS (SELECT node, min(c) AS component FROM r GROUP BY node), n AS (SELECT component, count(*) AS n FROM c GROUP BY component), m AS (SELECT count(*) AS components, round(max(n) / sum(n), 6) AS connected FROM n),
    o AS (SELECT count(*) AS edges, count(*) FILTER (WHERE good) AS valid, count(*) FILTER (WHERE negative) AS negative, count(*) FILTER (WHERE NOT negative AND same) AS self, count(*) FILTER (WHERE NOT negative AND NOT same AND far) AS outside, count(*) FILTER (WHERE good AND NOT posed) AS without_pose,
      round(count(*) FILTER (WHERE good AND posed) / count(*) FILTER (WHERE good), 6) AS pose_coverage, round(count(*) FILTER (WHERE good AND conf_t > 0 AND conf_r > 0) / count(*) FILTER (WHERE good), 6) AS split_coverage, count(*) FILTER (WHERE good AND NOT conf > 0) AS without_confidence,
      count(*) FILTER (WHERE good AND posed AND turn > 1.05) AS quaternion_outliers, count(*) FILTER (WHERE etype = 'A') AS type_a, count(*) FILTER (WHERE etype = 'N') AS type_n, count(*) FILTER (WHERE etype = 'R') AS type_r,
      round(quantile_cont(dx, 0.5) FILTER (WHERE good AND posed), 6) AS median_shift, round(quantile_cont(dx, 0.95) FILTER (WHERE good AND posed), 6) AS p95_shift, round(quantile_cont(abs(j - i)::DOUBLE, 0.5) FILTER (WHERE good), 6) AS median_gap, round(quantile_cont(abs(j - i)::DOUBLE, 0.95) FILTER (WHERE good), 6) AS p95_gap FROM g)
    SELECT o.*, components, connected, valid > 0 AND pose_coverage >= 0.95 AND split_coverage >= 0.8 AND without_confidence = 0 AND quaternion_outliers = 0 AND connected >= 0.8 AS ready FROM o, m"""


@query("edge_readiness", _READY)
def edge_readiness(spark, d):
    """Order lines as edges: some without a pose, a confidence or a proper quaternion, some of a frame with itself."""
    e = edges(spark, d)
    turn = F.when(F.col("eid") % 97 == 0, 1.2).otherwise(1.0)
    zero = F.lit(0.0)
    pose = F.when(F.col("eid") % 41 > 0, F.array(F.col("conf") / 10, zero, zero, zero, zero, 0.6 * turn, 0.8 * turn, zero, zero))
    rows = e.select((F.col("i") - 2).alias("i"), (F.col("j") - 2).alias("j"), "etype", "conf", F.when(F.col("eid") % 31 > 0, F.col("conf_t")).alias("conf_t"), (F.col("conf_r") - 0.9 * (F.col("eid") % 13 == 0).cast("int")).alias("conf_r"), pose.alias("pose"))
    return _r(stats.readiness(rows, table(spark, d, "part").count()), 6)


_POSES = "poses AS (SELECT p_partkey AS node, p_retailprice AS x, p_size::DOUBLE AS y FROM part)"


@query("edge_residuals", f"WITH {EDGES}, {_POSES} SELECT eid, round(b.x - a.x - conf, 4) + 0.0 AS rx, round(b.y - a.y - conf_r, 4) + 0.0 AS ry, round(sqrt(pow(b.x - a.x - conf, 2) + pow(b.y - a.y - conf_r, 2)), 4) AS residual FROM edges e JOIN poses a ON a.node = e.i JOIN poses b ON b.node = e.j")
def edge_residuals(spark, d):
    poses = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    rows = edges(spark, d).select("eid", "i", "j", F.col("conf").alias("dx"), F.col("conf_r").alias("dy"))
    return _r(graph.residuals(rows, poses).select("eid", "rx", "ry", "residual"))


@query("edge_whitening_scale", f"WITH {EDGES}, g AS (SELECT eid, conf, abs(i - j) AS gap FROM edges), s AS (SELECT quantile_cont(conf / gap, 0.5) AS s FROM g WHERE gap > 0 AND gap <= 10) SELECT eid, round(greatest(conf, s * sqrt(gap)), 5) AS scale FROM g, s")
def whitening(spark, d):
    rows = edges(spark, d).select("eid", "conf", F.abs(F.col("i") - F.col("j")).alias("gap"))
    return _r(graph.whitening(rows, "conf", "gap").select("eid", "scale"), 5)


#: Pixels are the places of the events, their luminance a number of each event.
_CELLS = "cells AS (SELECT cx, cy, avg(luma) < 0.5 AS occupied, count(*) AS n FROM (SELECT floor(floor(x) / 4)::BIGINT AS cx, floor(floor(y) / 4)::BIGINT AS cy, (id * 7 % 17) / 16.0::DOUBLE AS luma FROM traj) GROUP BY cx, cy)"


def _cells(spark, d):
    rows = trajectory(spark, d).select(F.floor("x").alias("px"), F.floor("y").alias("py"), (F.col("id") * 7 % 17 / 16.0).alias("luma"))
    return plan.occupancy(rows, 4, 0.5)


@query("plan_occupancy", f"WITH {TRAJ}, {_CELLS} SELECT * FROM cells")
def occupancy(spark, d):
    return _cells(spark, d)


@query("plan_point_lookup", f"WITH {TRAJ}, {_CELLS}, p AS (SELECT id, floor((x - 5) / 4)::BIGINT AS cx, floor(y / 4)::BIGINT AS cy FROM traj) SELECT id, p.cx, p.cy, coalesce(occupied, true) AS occupied FROM p LEFT JOIN cells USING (cx, cy)")
def point_lookup(spark, d):
    rows = trajectory(spark, d).select("id", (F.col("x") - 5).alias("x"), "y")
    return plan.looked_up(rows, _cells(spark, d), 4.0).select("id", "cx", "cy", "occupied")


@query(
    "line_occupancy",
    f"""WITH {TRAJ}, {_CELLS}, s AS (SELECT run, row_number() OVER {W} AS seg, x AS x0, y AS y0, lead(x) OVER {W} AS x1, lead(y) OVER {W} AS y1 FROM traj),
    p AS (SELECT *, greatest(1, ceil(sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) / 10.0))::BIGINT AS parts FROM s WHERE x1 IS NOT NULL), e AS (SELECT *, unnest(range(parts + 1)) AS k FROM p),
    h AS (SELECT run, seg, k, floor((x0 + (x1 - x0) * (k::DOUBLE / parts)) / 4)::BIGINT AS cx, floor((y0 + (y1 - y0) * (k::DOUBLE / parts)) / 4)::BIGINT AS cy FROM e),
    o AS (SELECT h.*, occupied, coalesce(occupied, true) AS occ, row_number() OVER (PARTITION BY run ORDER BY seg, k) AS n FROM h LEFT JOIN cells USING (cx, cy)),
    t AS (SELECT run, count(*) AS samples, round(avg(occ::INT), 6) AS occupied_ratio, round(avg((occupied IS NULL)::INT), 6) + 0.0 AS outside_ratio, count(DISTINCT (cx, cy)) AS cells FROM o GROUP BY run),
    g AS (SELECT run, n - row_number() OVER (PARTITION BY run ORDER BY n) AS g FROM o WHERE occ), l AS (SELECT run, g, count(*) AS len FROM g GROUP BY run, g), m AS (SELECT run, max(len) AS longest_hit FROM l GROUP BY run)
    SELECT run, samples, occupied_ratio, outside_ratio, t.cells, coalesce(longest_hit, 0) AS longest_hit FROM t LEFT JOIN m USING (run)""",
)
def line_occupancy(spark, d):
    return _r(plan.line_report(plan.line_samples(trajectory(spark, d), 10.0, "run", ["t", "id"]), _cells(spark, d), 4.0, "run"), 6)


@query(
    "similarity_fit",
    f"""WITH {TRAJ}, p AS (SELECT run, x, y, 2 * x - y + 3 AS u, x + 2 * y + (id % 3) AS v FROM traj), m AS (SELECT run, count(*) AS n, avg(x) mx, avg(y) my, avg(u) mu, avg(v) mv, avg(x*u + y*v) - avg(x)*avg(u) - avg(y)*avg(v) AS dt, avg(x*v - y*u) - avg(x)*avg(v) + avg(y)*avg(u) AS cr, avg(x*x + y*y) - avg(x)*avg(x) - avg(y)*avg(y) AS vr FROM p GROUP BY run)
    SELECT run, n, round(sqrt(pow(dt/vr, 2) + pow(cr/vr, 2)), 4) AS scale, round(degrees(atan2(cr/vr, dt/vr)), 3) AS angle, round(mu - dt/vr*mx + cr/vr*my, 3) + 0.0 AS dx, round(mv - cr/vr*mx - dt/vr*my, 3) + 0.0 AS dy FROM m""",
)
def similarity_fit(spark, d):
    x, y = F.col("x"), F.col("y")
    out = plan.fitted_similarity(trajectory(spark, d).select("run", "x", "y", (2 * x - y + 3).alias("u"), (x + 2 * y + F.col("id") % 3).alias("v")), "run")
    return out.select("run", "n", F.round("scale", 4).alias("scale"), *[(F.round(c, 3) + 0.0).alias(c) for c in ("angle", "dx", "dy")])


@query(
    "plan_anchor_transform",
    f"""WITH {TRAJ}, k AS (SELECT *, row_number() OVER {W} AS k, count(*) OVER (PARTITION BY run) AS n FROM traj), e AS (SELECT *, least(n, greatest(2, least(20, ceil(n / 10.0)))) AS e FROM k),
    s AS (SELECT run, max(x) FILTER (WHERE k = 1) AS x0, max(y) FILTER (WHERE k = 1) AS y0, max(x) FILTER (WHERE k = e) AS x1, max(y) FILTER (WHERE k = e) AS y1 FROM e GROUP BY run), a AS (SELECT *, radians(30) - atan2(y1 - y0, x1 - x0) AS a FROM s)
    SELECT id, round(400 + 1.5::DOUBLE * (cos(a) * (x - x0) - sin(a) * (y - y0)), 3) AS px, round(300 + 1.5::DOUBLE * (sin(a) * (x - x0) + cos(a) * (y - y0)), 3) AS py FROM traj JOIN a USING (run)""",
)
def anchor_transform(spark, d):
    return _r(plan.plan_points(trajectory(spark, d), "run", ["t", "id"], (400.0, 300.0), 30.0, 1.5).select("id", "px", "py"), 3)


@query("dominant_directions", f"WITH {STEPS}, a AS (SELECT step, degrees(atan2(dy, dx)) AS a FROM steps WHERE step > 0), b AS (SELECT least(35, floor((a - 180.0::DOUBLE * floor(a / 180.0::DOUBLE)) / 5.0::DOUBLE))::BIGINT AS bin, sum(step) AS length FROM a GROUP BY 1) SELECT bin, round(length, 3) AS length, round(length / sum(length) OVER (), 6) AS share FROM b")
def directions(spark, d):
    from ..operators.series import steps

    rows = steps(trajectory(spark, d)).filter("step > 0")
    out = plan.direction_bins(rows, F.col("step"), F.degrees(F.atan2("dy", "dx")))
    return out.select("bin", F.round("length", 3).alias("length"), F.round("share", 6).alias("share"))
