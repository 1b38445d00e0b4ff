"""Trajectory queries over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import heat, series as ops
from .bindings import TRAJ, trajectory
from .catalog import query

W = "(PARTITION BY run ORDER BY t, id)"
STEPS = f"{TRAJ}, moved AS (SELECT *, x - lag(x) OVER {W} AS dx, y - lag(y) OVER {W} AS dy, t - lag(t) OVER {W} AS dt FROM traj), steps AS (SELECT *, sqrt(dx*dx + dy*dy) AS step FROM moved)"
HEADING = f"{TRAJ}, chord AS (SELECT *, coalesce(lead(x, 2) OVER {W}, last_value(x) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - coalesce(lag(x, 2) OVER {W}, first_value(x) OVER {W}) AS cx, coalesce(lead(y, 2) OVER {W}, last_value(y) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - coalesce(lag(y, 2) OVER {W}, first_value(y) OVER {W}) AS cy FROM traj), head AS (SELECT *, CASE WHEN sqrt(cx*cx + cy*cy) > 0 THEN degrees(atan2(cy, cx)) END AS heading FROM chord)"


def _wrap(a: str) -> str:
    return f"(180.0::DOUBLE - ((180.0::DOUBLE - ({a})) - 360.0::DOUBLE * floor((180.0::DOUBLE - ({a})) / 360.0::DOUBLE)))"


RATE = f"{HEADING}, delta AS (SELECT *, coalesce({_wrap(f'heading - lag(heading) OVER {W}')}, 0) AS dd FROM head), med AS (SELECT *, quantile_cont(dd, 0.5) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM delta), rated AS (SELECT *, 0.25::DOUBLE * coalesce(lag(m) OVER {W}, 0) + 0.5::DOUBLE * m + 0.25::DOUBLE * coalesce(lead(m) OVER {W}, 0) AS rate FROM med)"
ARC = f"{STEPS}, arcs AS (SELECT *, sum(coalesce(step, 0)) OVER {W} AS arc, 1 AS one FROM steps), arc AS (SELECT *, CASE WHEN max(arc) OVER (PARTITION BY run) > 0 THEN arc / max(arc) OVER (PARTITION BY run) ELSE 0 END AS fraction FROM arcs)"
PROGRESS = f"{STEPS}, pr AS (SELECT run, sum(coalesce(step, 0)) AS length, sqrt(pow(arg_max(x, t) - arg_min(x, t), 2) + pow(arg_max(y, t) - arg_min(y, t), 2)) AS displacement, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS diagonal FROM steps GROUP BY run), prog AS (SELECT *, displacement / greatest(length, 1e-9) AS net_progress, diagonal / greatest(length, 1e-9) AS span_ratio, length / greatest(displacement, 1e-9) AS tortuosity FROM pr)"
REVERSE = f"long AS (SELECT * FROM steps WHERE step >= 0.25), bends AS (SELECT run, degrees(acos(greatest(-1, least(1, (dx * lead(dx) OVER {W} + dy * lead(dy) OVER {W}) / (step * lead(step) OVER {W}))))) >= 135 AS back FROM long), rev AS (SELECT run, coalesce(avg(back::INT), 0)::DOUBLE AS reverse_ratio FROM bends GROUP BY run)"


def _round(c, digits):
    """Rounded as in SQL, where what rounds to zero keeps its sign; Spark's round drops it."""
    return F.signum(c) * F.abs(F.round(c, digits))


def _r(df, digits=4):
    return df.select(*[_round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("traj_step_distance", f"WITH {STEPS} SELECT run, id, round(dx, 4) dx, round(dy, 4) dy, round(dt, 4) dt, round(step, 4) step FROM steps")
def step_distance(spark, d):
    return _r(ops.steps(trajectory(spark, d)).select("run", "id", "dx", "dy", "dt", "step"))


@query("traj_path_stats", f"WITH {STEPS} SELECT run, count(*) n, round(sum(coalesce(step, 0)), 4) AS length, round(quantile_cont(step, 0.5), 4) median_step, round(quantile_cont(step, 0.99), 4) p99_step FROM steps GROUP BY run")
def path_stats(spark, d):
    return _r(ops.path_stats(trajectory(spark, d)))


@query("traj_movement_summary", f"WITH {STEPS}, v AS (SELECT *, CASE WHEN dt > 0 THEN step / dt END AS v FROM steps) SELECT run, round(sum(coalesce(step, 0)), 4) AS distance, round(avg(v), 6) AS avg_speed, round(max(v), 6) AS max_speed, count(*) AS n FROM v GROUP BY run")
def movement_summary(spark, d):
    out = ops.movement_summary(trajectory(spark, d))
    return out.select("run", F.round("distance", 4).alias("distance"), F.round("avg_speed", 6).alias("avg_speed"), F.round("max_speed", 6).alias("max_speed"), "n")


@query("traj_progress_metrics", f"WITH {PROGRESS} SELECT run, round(length, 4) AS length, round(displacement, 4) displacement, round(diagonal, 4) diagonal, round(net_progress, 4) net_progress, round(span_ratio, 4) span_ratio, round(tortuosity, 3) tortuosity FROM prog")
def progress(spark, d):
    return _r(ops.progress(trajectory(spark, d)).withColumn("tortuosity", F.round("tortuosity", 3)))


@query("traj_reverse_ratio", f"WITH {STEPS}, {REVERSE} SELECT run, round(reverse_ratio, 4) AS reverse_ratio FROM rev")
def reverse_ratio(spark, d):
    return _r(ops.reverse_ratio(trajectory(spark, d)))


@query("traj_quality_gate", f"WITH {PROGRESS}, {REVERSE}, q AS (SELECT p.run, list_filter([CASE WHEN diagonal < 1 THEN 'collapsed' END, CASE WHEN tortuosity > 100 THEN 'wanders' END, CASE WHEN reverse_ratio > 0.3 THEN 'reverses' END, CASE WHEN net_progress < 0.001 THEN 'goes_nowhere' END], lambda r: r IS NOT NULL) AS why FROM prog p LEFT JOIN rev USING (run)) SELECT run, len(why) = 0 AS accepted, array_to_string(why, ',') AS reasons FROM q")
def quality_gate(spark, d):
    return ops.quality_gate(trajectory(spark, d))


GAPPED = f"{TRAJ}, gapped AS (SELECT run, id, t, CASE WHEN id % 3 = 0 THEN NULL ELSE x END AS x FROM traj)"


@query(
    "traj_gap_fill",
    f"""WITH {GAPPED}, s AS (SELECT *, last_value(x IGNORE NULLS) OVER b AS a, last_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER b AS ta,
    first_value(x IGNORE NULLS) OVER f AS c, first_value(CASE WHEN x IS NOT NULL THEN t END IGNORE NULLS) OVER f AS tc FROM gapped
    WINDOW b AS (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY run ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT run, id, round(coalesce(x, a + (c - a) * (t - ta) / nullif(tc - ta, 0), a, c, 0), 4) AS x FROM s""",
)
def gap_fill(spark, d):
    rows = trajectory(spark, d).withColumn("x", F.when(F.col("id") % 3 != 0, F.col("x")))
    return _r(ops.gap_fill(rows, "x", "t").select("run", "id", "x"))


@query(
    "traj_step_clip",
    f"""WITH {STEPS}, l AS (SELECT run, greatest(3 * quantile_cont(step, 0.5), 2 * quantile_cont(step, 0.75)) AS lim FROM steps GROUP BY run),
    j AS (SELECT s.*, least(1, lim / greatest(step, 1e-12)) AS k FROM steps s JOIN l USING (run))
    SELECT run, id, round(first_value(x) OVER {W} + coalesce(sum(dx * k) OVER {W}, 0), 4) AS cx, round(first_value(y) OVER {W} + coalesce(sum(dy * k) OVER {W}, 0), 4) AS cy FROM j""",
)
def step_clip(spark, d):
    return _r(ops.clipped(trajectory(spark, d)).select("run", "id", "cx", "cy"))


@query(
    "traj_centred_mean",
    f"""WITH {TRAJ}, k AS (SELECT *, row_number() OVER {W} AS k, count(*) OVER (PARTITION BY run) AS n, first_value(x) OVER {W} AS fx, arg_max(x, t) OVER (PARTITION BY run) AS lx FROM traj)
    SELECT run, id, round((sum(x) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) + greatest(0, 5 - k) * fx + greatest(0, 4 - (n - k)) * lx) / 9, 4) AS mx FROM k""",
)
def centred_mean(spark, d):
    return _r(ops.centred_mean(trajectory(spark, d), {"x": "mx"}, 4).select("run", "id", "mx"))


@query("traj_heading", f"WITH {HEADING} SELECT run, id, round(heading, 4) AS heading FROM head")
def heading(spark, d):
    return _r(ops.heading(trajectory(spark, d)).select("run", "id", "heading"))


@query("traj_heading_unwrap", f"WITH {HEADING}, h AS (SELECT * FROM head WHERE heading IS NOT NULL), u AS (SELECT *, coalesce({_wrap(f'heading - lag(heading) OVER {W}')}, 0) AS turn FROM h) SELECT run, id, round(first_value(heading) OVER {W} + sum(turn) OVER {W}, 3) + 0.0 AS unwrapped FROM u")
def heading_unwrap(spark, d):
    return _r(ops.unwrapped(ops.heading(trajectory(spark, d)).filter("heading is not null"), "heading").select("run", "id", "unwrapped"), 3).withColumn("unwrapped", F.col("unwrapped") + 0.0)


@query("traj_heading_rate_smooth", f"WITH {RATE} SELECT run, id, round(rate, 4) AS rate FROM rated")
def heading_rate(spark, d):
    return _r(ops.heading_rate(ops.heading(trajectory(spark, d))).select("run", "id", "rate"))


@query(
    "traj_turn_events",
    f"""WITH {RATE}, s AS (SELECT *, CASE WHEN abs(rate) >= 5 THEN sign(rate) ELSE 0 END AS sg FROM rated), n AS (SELECT *, CASE WHEN lag(sg) OVER {W} = sg THEN 0 ELSE 1 END AS nw FROM s),
    i AS (SELECT *, sum(nw) OVER {W} AS island FROM n), g AS (SELECT run, island, min(t) AS "start", max(t) AS "end", count(*) AS n, sum(rate) AS angle FROM i WHERE sg <> 0 GROUP BY run, island)
    SELECT run, "start", "end", n, round(angle, 4) AS angle, CASE WHEN abs(angle) >= 135 THEN 'u_turn' WHEN angle > 0 THEN 'left' ELSE 'right' END AS kind FROM g WHERE abs(angle) >= 12""",
)
def turn_events(spark, d):
    out = ops.sign_islands(ops.heading_rate(ops.heading(trajectory(spark, d))), "rate", 5.0, 12.0)
    return out.select("run", "start", "end", "n", F.round("angle", 4).alias("angle"), "kind")


@query("traj_reported_turns", f"""WITH {RATE} SELECT run, id, round(rate, 4) AS rate FROM rated WHERE abs(rate) BETWEEN 12 AND 100""")
def reported_turns(spark, d):
    return _r(ops.heading_rate(ops.heading(trajectory(spark, d))).filter(F.abs("rate").between(12, 100)).select("run", "id", "rate"))


@query("traj_true_runs", f"WITH {TRAJ}, k AS (SELECT run, row_number() OVER {W} - 1 AS k, x > 50 AS f FROM traj), g AS (SELECT run, k, k - row_number() OVER (PARTITION BY run ORDER BY k) AS g FROM k WHERE f) SELECT run, min(k) AS first, max(k) AS last, count(*) AS n FROM g GROUP BY run, g")
def true_runs(spark, d):
    return ops.true_runs(trajectory(spark, d), F.col("x") > 50)


@query("traj_fallback_clusters", f"WITH {TRAJ}, v AS (SELECT DISTINCT run, floor(t / 3600)::BIGINT AS hour FROM traj), n AS (SELECT *, CASE WHEN hour - lag(hour) OVER (PARTITION BY run ORDER BY hour) <= 4 THEN 0 ELSE 1 END AS nw FROM v), c AS (SELECT *, sum(nw) OVER (PARTITION BY run ORDER BY hour) AS c FROM n) SELECT run, min(hour) AS first, max(hour) AS last, count(*) AS n FROM c GROUP BY run, c")
def fallback_clusters(spark, d):
    rows = trajectory(spark, d).withColumn("hour", F.floor(F.col("t") / 3600))
    return ops.gap_clusters(rows, "hour", 4)


@query("traj_arc_fraction", f"WITH {ARC} SELECT run, id, round(arc, 4) AS arc, round(fraction, 6) AS fraction FROM arc")
def arc_fraction(spark, d):
    return ops.arc_fraction(trajectory(spark, d)).select("run", "id", F.round("arc", 4).alias("arc"), F.round("fraction", 6).alias("fraction"))


@query(
    "traj_resample",
    f"""WITH {ARC}, seg AS (SELECT run, lag(fraction) OVER {W} AS f0, fraction AS f1, lag(x) OVER {W} AS x0, x AS x1, lag(y) OVER {W} AS y0, y AS y1 FROM arc),
    k AS (SELECT unnest(range(33)) AS k) SELECT run, k::BIGINT AS k, round(x0 + (x1 - x0) * (k / 32.0::DOUBLE - f0) / (f1 - f0), 3) AS x, round(y0 + (y1 - y0) * (k / 32.0::DOUBLE - f0) / (f1 - f0), 3) AS y
    FROM seg, k WHERE f1 > f0 AND k / 32.0::DOUBLE <= f1 AND (k / 32.0::DOUBLE > f0 OR f0 = 0 AND k = 0)""",
)
def resample(spark, d):
    return _r(ops.resampled(trajectory(spark, d), 33), 3)


@query(
    "traj_densify",
    f"""WITH {TRAJ}, s AS (SELECT *, lead(x) OVER {W} AS nx, lead(y) OVER {W} AS ny FROM traj), p AS (SELECT *, coalesce(greatest(1, ceil(sqrt(pow(nx - x, 2) + pow(ny - y, 2)) / 25.0)), 1)::BIGINT AS parts FROM s),
    e AS (SELECT *, unnest(range(parts)) AS part FROM p) SELECT run, id, part, round(coalesce(x + (nx - x) * (part::DOUBLE / parts), x), 8) AS x, round(coalesce(y + (ny - y) * (part::DOUBLE / parts), y), 8) AS y FROM e""",
)
def densify(spark, d):
    return _r(ops.densified(trajectory(spark, d), 25.0), 8)


@query("traj_trend_blocks", f"WITH {TRAJ}, b AS (SELECT run, floor((t - min(t) OVER (PARTITION BY run)) / 172800)::BIGINT AS block, x, y FROM traj) SELECT run, block, count(*) AS n, round(quantile_cont(x, 0.5), 4) AS x, round(quantile_cont(y, 0.5), 4) AS y FROM b GROUP BY run, block")
def trend_blocks(spark, d):
    return _r(ops.block_medians(trajectory(spark, d), 172800.0))


@query(
    "traj_moving_duration",
    f"""WITH {STEPS}, l AS (SELECT run, quantile_cont(step, 0.2) AS a, quantile_cont(step, 0.9) AS b FROM steps GROUP BY run),
    f AS (SELECT s.run, s.t, s.id, dt, coalesce((step > a + 0.25::DOUBLE * (b - a))::INT, 0) AS f FROM steps s JOIN l USING (run)), n AS (SELECT *, max(f) OVER (PARTITION BY run ORDER BY t, id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM f)
    SELECT run, round(coalesce(nullif(sum(dt) FILTER (WHERE near = 1), 0), sum(dt), 0), 3) AS moving, round(coalesce(sum(dt), 0), 3) AS total FROM n GROUP BY run""",
)
def moving_duration(spark, d):
    return _r(ops.moving_time(trajectory(spark, d)), 3)


@query("traj_forward_heading", f"WITH {TRAJ}, a AS (SELECT *, degrees(atan2(lead(y) OVER {W} - y, lead(x) OVER {W} - x)) AS a FROM traj) SELECT run, id, round(coalesce(a, lag(a) OVER {W}, 0), 2) AS heading FROM a")
def forward_heading(spark, d):
    return ops.forward_heading(trajectory(spark, d)).select("run", "id", "heading")


@query("circular_mean_heading", f"WITH {HEADING} SELECT run, round(degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))), 3) AS mean_heading, round(sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)), 4) AS concentration FROM head GROUP BY run")
def circular_mean(spark, d):
    return _r(ops.circular_mean(ops.heading(trajectory(spark, d)), "heading", "run").withColumn("mean_heading", F.round("mean_heading", 3)))


@query("traj_index_anchors", f"WITH {TRAJ}, k AS (SELECT *, row_number() OVER {W} - 1 AS k, count(*) OVER (PARTITION BY run) AS n FROM traj) SELECT run, k FROM k WHERE k = 0 OR k = n - 1 OR kind = 'purchase' OR k % greatest(10, n // 24) = 0")
def index_anchors(spark, d):
    rows = trajectory(spark, d)
    return ops.index_anchors(rows, F.col("kind") == "purchase").select("run", F.col("k").cast("long").alias("k"))


@query("traj_heatmap", f"WITH {TRAJ}, c AS (SELECT floor(x / 20)::BIGINT AS gx, floor(y / 20)::BIGINT AS gy, count(*) AS n FROM traj GROUP BY 1, 2) SELECT gx, gy, n, round(n / max(n) OVER (), 6) AS intensity FROM c")
def heatmap(spark, d):
    return _r(heat.heatmap(trajectory(spark, d), 20.0), 6)
