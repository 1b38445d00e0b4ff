"""Join, statistics, task and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, stats, tasks as tk
from .bindings import CLOUD, EDGES, TASKS, TRAJ, cloud, edges, table, tasks, trajectory
from .catalog import query


def _r(df, digits=4):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


_LEFT = "l AS (SELECT run, id, t, x FROM traj WHERE id % 2 = 0), r AS (SELECT run, id, t, x FROM traj WHERE id % 2 = 1)"


@query(
    "series_asof_lerp",
    f"""WITH {TRAJ}, {_LEFT}, p AS (SELECT l.run, l.id, l.t, r.t AS ta, r.x AS a FROM l ASOF LEFT JOIN r ON l.run = r.run AND l.t >= r.t),
    q AS (SELECT p.*, r.t AS tb, r.x AS b FROM p ASOF LEFT JOIN r ON p.run = r.run AND p.t <= r.t)
    SELECT run, id, round(coalesce(a + (b - a) * CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END, a, b), 4) + 0.0 AS v FROM q""",
)
def asof_lerp(spark, d):
    rows = trajectory(spark, d)
    right = rows.filter("id % 2 = 1").select("run", "t", F.col("x").alias("v"))
    return _r(joins.as_of(rows.filter("id % 2 = 0").select("run", "id", "t"), right, "run", "t", "v").select("run", "id", "v"))


@query(
    "series_asof_nearest",
    f"""WITH {TRAJ}, {_LEFT}, p AS (SELECT l.run, l.id, l.t, r.t AS ta, r.x AS a FROM l ASOF LEFT JOIN r ON l.run = r.run AND l.t >= r.t),
    q AS (SELECT p.*, r.t AS tb, r.x AS b FROM p ASOF LEFT JOIN r ON p.run = r.run AND p.t <= r.t)
    SELECT run, id, round(coalesce(CASE WHEN tb IS NULL OR t - ta <= tb - t THEN a ELSE b END, a, b), 4) + 0.0 AS v FROM q""",
)
def asof_nearest(spark, d):
    rows = trajectory(spark, d)
    right = rows.filter("id % 2 = 1").select("run", "t", F.col("x").alias("v"))
    return _r(joins.as_of(rows.filter("id % 2 = 0").select("run", "id", "t"), right, "run", "t", "v", nearest=True).select("run", "id", "v"))


@query(
    "nearest_event_match",
    f"""WITH {TRAJ}, l AS (SELECT run, id, t FROM traj WHERE kind = 'purchase'), r AS (SELECT run, id AS k, t AS tr FROM traj WHERE kind <> 'purchase')
    SELECT l.run, l.id, arg_min(k, struct_pack(d := abs(tr - t), k := k)) AS nearest, round(min(abs(tr - t)), 3) + 0.0 AS distance FROM l LEFT JOIN r USING (run) GROUP BY l.run, l.id""",
)
def nearest_event(spark, d):
    rows = trajectory(spark, d)
    return _r(joins.nearest_rows(rows.filter("kind = 'purchase'").select("run", "id", "t"), rows.filter("kind <> 'purchase'").select("run", "t", F.col("id").alias("k")), "run", "t", "k").select("run", "id", "nearest", "distance"), 3)


@query(
    "turn_band_candidates",
    f"WITH {TRAJ}, l AS (SELECT run, id AS l, t FROM traj WHERE kind = 'purchase'), r AS (SELECT run, id AS r, t AS q FROM traj WHERE kind = 'click') SELECT l.run, l.l, r.r, round(q - t, 3) + 0.0 AS \"offset\" FROM l JOIN r ON l.run = r.run AND abs(t - q) <= 43200",
)
def band(spark, d):
    rows = trajectory(spark, d)
    left, right = rows.filter("kind = 'purchase'").select("run", F.col("id").alias("l"), "t"), rows.filter("kind = 'click'").select("run", F.col("id").alias("r"), "t")
    return _r(joins.band_join(left, right, "run", "t", 43200.0), 3)


@query(
    "knn_grid_cells",
    f"""WITH {TRAJ}, c AS (SELECT i * 10 + j AS cell, i * 10.0::DOUBLE + 5 AS cx, j * 10.0::DOUBLE + 5 AS cy FROM range(10) a(i), range(10) b(j)),
    n AS (SELECT id, cell, sqrt(pow(x - cx, 2) + pow(y - cy, 2)) AS dist FROM traj, c), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, cell) AS rank FROM n WHERE dist <= 12)
    SELECT id, cell, rank, round(dist, 4) + 0.0 AS distance FROM k WHERE rank <= 4""",
)
def knn(spark, d):
    cells = spark.range(100).select(F.col("id").alias("cell"), (F.floor(F.col("id") / 10) * 10.0 + 5).alias("cx"), (F.col("id") % 10 * 10.0 + 5).alias("cy"))
    return _r(joins.neighbours(trajectory(spark, d), cells, 12.0, 4))


_SCORE = "sqrt(conf_t * conf_r)"


@query(
    "edge_dedup_strongest",
    f"WITH {EDGES}, p AS (SELECT least(i, j) AS i, greatest(i, j) AS j, i > j AS rev, {_SCORE} AS score, eid FROM edges e WHERE e.i <> e.j), k AS (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY score DESC, eid) AS k, count(*) OVER (PARTITION BY i, j) AS n FROM p) SELECT i, j, round(score, 4) + 0.0 AS score, rev AS reversed, eid AS tie, n FROM k WHERE k = 1",
)
def strongest(spark, d):
    return _r(joins.strongest_edges(edges(spark, d), "i", "j", F.sqrt(F.col("conf_t") * F.col("conf_r")), "eid"))


@query("edge_backbone", f"WITH {EDGES}, b AS (SELECT *, abs(j - i) AS gap, row_number() OVER (PARTITION BY j ORDER BY abs(j - i), conf DESC, eid) AS k FROM edges WHERE i <> j) SELECT j, i, gap, conf, eid FROM b WHERE k = 1")
def backbone(spark, d):
    rows = edges(spark, d).filter("i <> j").withColumn("gap", F.abs(F.col("j") - F.col("i")))
    best = rows.groupBy("j").agg(F.min(F.struct("gap", (-F.col("conf")).alias("c"), "eid", "i")).alias("m"))
    return best.select("j", "m.i", "m.gap", (-F.col("m.c")).alias("conf"), "m.eid")


@query("edge_union_dedup", f"WITH {EDGES}, u AS (SELECT i, j, etype, conf, eid FROM edges WHERE etype <> 'A' UNION ALL SELECT i, j, etype, conf, eid FROM edges WHERE etype <> 'R') SELECT i, j, etype, max(conf) AS conf, count(*) AS n FROM u GROUP BY i, j, etype")
def union_dedup(spark, d):
    rows = edges(spark, d).select("i", "j", "etype", "conf", "eid")
    both = rows.filter("etype <> 'A'").unionByName(rows.filter("etype <> 'R'"))
    return both.groupBy("i", "j", "etype").agg(F.max("conf").alias("conf"), F.count(F.lit(1)).alias("n"))


@query(
    "frame_overlap_merge",
    f"WITH {CLOUD}, a AS (SELECT pid, conf FROM cloud WHERE frame <= 6), b AS (SELECT pid, g AS conf FROM cloud WHERE frame >= 4) SELECT a.pid, round(greatest(a.conf, b.conf), 6) + 0.0 AS conf FROM a LEFT JOIN b USING (pid) UNION ALL SELECT pid, round(conf, 6) + 0.0 FROM b WHERE pid NOT IN (SELECT pid FROM a)",
)
def overlap(spark, d):
    rows = cloud(spark, d)
    early, late = rows.filter("frame <= 6").select("pid", "conf"), rows.filter("frame >= 4").select("pid", F.col("g").alias("conf"))
    return _r(joins.overlap_merge(early, late, "pid", "conf"), 6)


@query("source_precedence", f"WITH {TASKS}, u AS (SELECT employee, 0 AS source, size FROM tasks WHERE status = 'P' UNION ALL SELECT employee, 1, size FROM tasks WHERE status = 'F' UNION ALL SELECT employee, 2, size FROM tasks WHERE status = 'O'), k AS (SELECT *, row_number() OVER (PARTITION BY employee ORDER BY source, size) AS k FROM u) SELECT employee, source, size FROM k WHERE k = 1")
def precedence(spark, d):
    rows = tasks(spark, d)
    return joins.by_precedence([rows.filter(F.col("status") == k) for k in ("P", "F", "O")], "employee", "size")


@query(
    "employee_prefix_merge",
    f"WITH {TASKS}, c AS (SELECT id, employee, created_at FROM tasks WHERE status = 'O') SELECT c.id AS chosen, t.employee, t.id, t.created_at FROM c JOIN tasks t USING (employee) WHERE (t.created_at < c.created_at OR t.created_at = c.created_at AND t.id <= c.id) AND t.id NOT IN (SELECT id FROM tasks WHERE status = 'P')",
)
def prefix(spark, d):
    rows = tasks(spark, d).select("id", "employee", "created_at", "status")
    return joins.prefix_of(rows.drop("status"), rows.filter("status = 'O'"), rows.filter("status = 'P'"))


@query("run_quantile_summary", f"WITH {TRAJ} SELECT run, count(x) AS n, {', '.join(f'round(quantile_cont(x, {q}), 6) AS {c}' for c, q in (('min', 0), ('p10', 0.1), ('p50', 0.5), ('p90', 0.9), ('max', 1)))} FROM traj GROUP BY run".replace("AS min", 'AS "min"').replace("AS max", 'AS "max"'))
def quantiles(spark, d):
    return stats.five_numbers(trajectory(spark, d), "x", "run")


@query("edge_quality_report", f"WITH {EDGES}, g AS (SELECT count(*) AS edges, count(*) FILTER (WHERE i < 0 OR j < 0) AS negative, count(*) FILTER (WHERE i = j) AS self, count(*) FILTER (WHERE i >= 150 OR j >= 150) AS out_of_range, count(*) FILTER (WHERE conf_t IS NOT NULL AND conf_r IS NOT NULL) AS split_confidence, count(*) FILTER (WHERE etype = 'A') AS type_a, count(*) FILTER (WHERE etype = 'N') AS type_n, count(*) FILTER (WHERE etype = 'R') AS type_r, quantile_cont(conf, 0.5) AS median_conf FROM edges) SELECT *, edges > 0 AND negative = 0 AND self * 100 <= edges AND split_confidence = edges AS ready FROM g")
def edge_report(spark, d):
    return stats.edge_report(edges(spark, d), 150)


@query(
    "weighted_percentile",
    f"WITH {TRAJ}, w AS (SELECT run, x, sum(y) OVER (PARTITION BY run ORDER BY x, id) AS c, sum(y) OVER (PARTITION BY run) AS s FROM traj) SELECT run, min(x) AS value FROM w WHERE c >= 0.9::DOUBLE * s GROUP BY run",
)
def weighted_percentile(spark, d):
    return stats.weighted_percentile(trajectory(spark, d), "x", "y", "run", 0.9, "id")


@query("weighted_objective", f"WITH {TRAJ} SELECT run, round(sum((y + 1) * least((x - 50) * (x - 50), 400)) / sum(y + 1), 4) AS objective, round(sum(CASE WHEN abs(x - 50) <= 20 THEN y + 1 ELSE 0 END) / sum(y + 1), 6) AS inliers FROM traj GROUP BY run")
def objective(spark, d):
    rows = trajectory(spark, d).select("run", (F.col("x") - 50).alias("r"), (F.col("y") + 1).alias("w"))
    out = stats.clipped_objective(rows, "r", "w", "run", 20.0)
    return out.select("run", F.round("objective", 4).alias("objective"), F.round("inliers", 6).alias("inliers"))


_HOLED = f"{TRAJ}, v AS (SELECT run, id, CASE WHEN id % 5 = 0 THEN NULL ELSE x END AS c FROM traj)"


@query("robust_confidence_weights", f"WITH {_HOLED}, q AS (SELECT run, quantile_cont(c, 0.1) AS a, quantile_cont(c, 0.5) AS m, quantile_cont(c, 0.9) AS b FROM v GROUP BY run) SELECT v.run, id, round(coalesce(greatest(0, least(1, (coalesce(c, m) - a) / nullif(b - a, 0))), 0.5), 6) + 0.0 AS weight FROM v JOIN q USING (run)")
def robust(spark, d):
    rows = trajectory(spark, d).select("run", "id", F.when(F.col("id") % 5 != 0, F.col("x")).alias("c"))
    return _r(stats.robust_weights(rows, "c", "run").select("run", "id", "weight"), 6)


@query("median_scale_weights", f"WITH {CLOUD}, m AS (SELECT quantile_cont(conf, 0.5) AS m FROM cloud WHERE conf > 0) SELECT pid, round(greatest(0.1, least(10, conf / m)), 6) + 0.0 AS weight FROM cloud, m")
def median_scale(spark, d):
    return _r(stats.median_ratio(cloud(spark, d).select("pid", "conf"), "conf").select("pid", "weight"), 6)


@query("frame_conf_median", f"WITH {CLOUD} SELECT frame, round(quantile_cont(conf, 0.5), 6) + 0.0 AS median_conf, count(*) AS n FROM cloud WHERE isfinite(conf) GROUP BY frame")
def frame_median(spark, d):
    return _r(cloud(spark, d).filter(~F.isnan("conf")).groupBy("frame").agg(F.percentile("conf", F.lit(0.5)).alias("median_conf"), F.count(F.lit(1)).alias("n")), 6)


@query("mad_outliers", f"WITH {TRAJ}, m AS (SELECT run, quantile_cont(x, 0.5) AS m FROM traj GROUP BY run), f AS (SELECT t.run, id, abs(x - m) AS dev FROM traj t JOIN m USING (run)), s AS (SELECT run, quantile_cont(dev, 0.5) AS mad FROM f GROUP BY run) SELECT f.run, f.id FROM f JOIN s USING (run) WHERE dev > 1.2::DOUBLE * 1.4826::DOUBLE * greatest(mad, 1e-12)")
def outliers(spark, d):
    return stats.mad_outliers(trajectory(spark, d).select("run", "id", "x"), "x", "run", 1.2).select("run", "id")


@query("run_ratios", f"WITH {TRAJ} SELECT run, count(*) AS n, round(count(*) FILTER (WHERE kind = 'click') / count(*), 6) AS clicks, round(count(*) FILTER (WHERE x > 75) / count(*), 6) AS high FROM traj GROUP BY run")
def ratios(spark, d):
    return _r(stats.ratios(trajectory(spark, d), "run", {"clicks": F.col("kind") == "click", "high": F.col("x") > 75}), 6)


@query("run_dominant_mode", f"WITH {TRAJ}, c AS (SELECT run, kind, count(*) AS n FROM traj GROUP BY run, kind), k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY n DESC, kind) AS k FROM c) SELECT run, kind AS dominant, n FROM k WHERE k = 1")
def dominant(spark, d):
    return stats.dominant(trajectory(spark, d), "run", "kind")


@query("calibration_reliability", "WITH s AS (SELECT least(1, n_chars / 6000.0::DOUBLE) AS score, quality FROM labels JOIN documents USING (doc_id)) SELECT least(9, floor(score * 10))::BIGINT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS rate FROM s GROUP BY 1")
def reliability(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 6000.0).alias("score"), "quality")
    return _r(stats.reliability(rows, "score", "quality", 10), 6)


@query("task_latest_upsert", f"WITH {TASKS}, k AS (SELECT *, row_number() OVER (PARTITION BY employee ORDER BY created_at DESC, id DESC) AS k FROM tasks) SELECT id, employee, status, created_at FROM k WHERE k = 1")
def upsert(spark, d):
    return tk.latest(tasks(spark, d).select("id", "employee", "status", "created_at"), "employee", "created_at", "id")


@query("task_batch_rank", f"WITH {TASKS} SELECT id, employee, count(*) OVER (PARTITION BY employee ORDER BY created_at RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW) AS size, row_number() OVER (PARTITION BY employee ORDER BY created_at, id) AS rank FROM tasks")
def batch_rank(spark, d):
    return tk.batch_rank(tasks(spark, d), 30 * 86400)


@query("task_unread", f"WITH {TASKS} SELECT employee, count(*) AS unread FROM tasks WHERE id NOT IN (SELECT id FROM tasks WHERE status = 'F') GROUP BY employee")
def unread(spark, d):
    rows = tasks(spark, d)
    return tk.unread(rows, rows.filter("status = 'F'"), "id", "employee")


@query("task_owner_counts", f"WITH {TASKS} SELECT employee, status, count(*) AS n FROM tasks GROUP BY employee, status")
def owner_counts(spark, d):
    return tasks(spark, d).groupBy("employee", "status").agg(F.count(F.lit(1)).alias("n"))


@query("task_registry_list", "SELECT o.o_orderkey AS id, c.c_name AS employee, o.o_orderstatus AS status, o.o_orderdate AS created_at FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def registry_list(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("employee"), "c_name")
    return tasks(spark, d).join(customer, "employee").select("id", F.col("c_name").alias("employee"), "status", "created_at")


@query("task_delete_cascade", f"WITH {TASKS} SELECT id, employee FROM tasks WHERE employee NOT IN (SELECT employee FROM tasks WHERE size > 400000)")
def delete_cascade(spark, d):
    rows = tasks(spark, d)
    return rows.join(rows.filter("size > 400000").select("employee").distinct(), "employee", "left_anti").select("id", "employee")


@query("stage_timings", f"WITH {TRAJ}, s AS (SELECT *, lead(t) OVER (PARTITION BY run ORDER BY t, id) - t AS sec FROM traj) SELECT run, kind, round(sum(coalesce(sec, 0)), 3) AS seconds, count(*) AS visits FROM s GROUP BY run, kind")
def stage_timings(spark, d):
    return _r(tk.stage_durations(trajectory(spark, d)), 3)


@query(
    "stage_progress",
    f"""WITH {TRAJ}, dim(stage, low, high, typical) AS (VALUES {', '.join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for n, a, b, c in tk.STAGES)}),
    s AS (SELECT run, id, t, CASE kind WHEN 'view' THEN 'upload' WHEN 'click' THEN 'gpu' WHEN 'purchase' THEN 'map' ELSE 'trajectory' END AS stage, y * 10 AS seconds FROM traj)
    SELECT run, id, round(max(coalesce(low + (high - low) * least(0.97, 1 - exp(-seconds / typical)), 0)) OVER (PARTITION BY run ORDER BY t, id), 4) + 0.0 AS progress FROM s LEFT JOIN dim USING (stage)""",
)
def stage_progress(spark, d):
    stage = F.when(F.col("kind") == "view", "upload").when(F.col("kind") == "click", "gpu").when(F.col("kind") == "purchase", "map").otherwise("trajectory")
    log = trajectory(spark, d).select("run", "id", "t", stage.alias("stage"), (F.col("y") * 10).alias("seconds"))
    return _r(tk.stage_progress(log, [F.col("t"), F.col("id")]).select("run", "id", "progress"))


@query("segment_windows", f"WITH {TRAJ}, n AS (SELECT run, count(*) AS n FROM traj GROUP BY run), k AS (SELECT *, unnest(range(CASE WHEN n <= 15 THEN 1 ELSE ceil((n - 15) / 12.0)::BIGINT + 1 END)) AS k FROM n) SELECT run, k, least(k * 12, greatest(0, n - 15)) AS first, least(n, least(k * 12, greatest(0, n - 15)) + 15) AS last FROM k")
def segment_windows(spark, d):
    return tk.hopping_windows(trajectory(spark, d).groupBy("run").agg(F.count(F.lit(1)).alias("n")), 15, 12)


@query(
    "tiered_selection",
    f"WITH {EDGES}, a AS (SELECT i, eid, CASE etype WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS tier, conf_t FROM edges WHERE conf >= 40), f AS (SELECT *, min(tier) OVER (PARTITION BY i) AS best FROM a), k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY conf_t DESC, eid) AS k FROM f WHERE tier = best) SELECT i, eid, tier, conf_t FROM k WHERE k = 1",
)
def tiered(spark, d):
    rows = edges(spark, d).select("i", "eid", F.when(F.col("etype") == "N", 0).when(F.col("etype") == "R", 1).otherwise(2).alias("tier"), "conf_t", (F.col("conf") >= 40).alias("ok"))
    return tk.tiered(rows, "i", "tier", "ok", [F.desc("conf_t"), F.col("eid")]).select("i", "eid", "tier", "conf_t")


@query(
    "stratified_topk",
    f"WITH {EDGES}, p AS (SELECT *, row_number() OVER (PARTITION BY etype ORDER BY conf_t DESC, eid) AS k, row_number() OVER (ORDER BY conf_t DESC, eid) AS o FROM edges) SELECT eid, etype, conf_t FROM p WHERE k <= 6 OR o <= 18",
)
def stratified(spark, d):
    return tk.stratified_top(edges(spark, d).select("eid", "etype", "conf_t"), "etype", "conf_t", 6, 18, "eid")


@query(
    "hypothesis_grid_best",
    f"WITH {TRAJ}, f AS (SELECT 0.5::DOUBLE + 0.25::DOUBLE * i AS factor FROM range(10) r(i)), c AS (SELECT run, factor, avg(abs(x * factor - y)) AS cost FROM traj, f GROUP BY run, factor) SELECT run, arg_min(factor, struct_pack(c := round(cost, 9), f := factor)) AS factor, round(min(round(cost, 9)), 6) AS cost FROM c GROUP BY run",
)
def grid(spark, d):
    return _r(tk.grid_best(trajectory(spark, d), [0.5 + 0.25 * i for i in range(10)], "run", lambda f: F.round(F.avg(F.abs(F.col("x") * f - F.col("y"))), 9)), 6)


@query(
    "json_context_merge",
    """WITH j AS (SELECT user_id, arg_max(props, event_id) AS a, arg_max(event_type, event_id) AS ta, arg_min(props, event_id) AS b, arg_min(event_type, event_id) AS tb FROM events GROUP BY user_id)
    SELECT user_id, json_extract_string(b, '$.k') AS k, ta AS origin, CASE WHEN tb = 'click' THEN NULL ELSE tb END AS note FROM j""",
)
def context_merge(spark, d):
    last, first = F.max_by(F.struct("props", "event_type"), "event_id"), F.min_by(F.struct("props", "event_type"), "event_id")
    ends = table(spark, d, "events").groupBy("user_id").agg(last.alias("a"), first.alias("b"))
    text = "map<string,string>"
    old = ends.select("user_id", F.map_concat(F.from_json("a.props", text), F.create_map(F.lit("origin"), F.col("a.event_type"), F.lit("note"), F.lit("kept"))).alias("context"))
    new = ends.select("user_id", F.map_concat(F.from_json("b.props", text), F.create_map(F.lit("note"), F.when(F.col("b.event_type") != "click", F.col("b.event_type")))).alias("context"))
    merged = tk.merged_context(old, new, "user_id", "context")
    return merged.select("user_id", *[F.try_element_at("context", F.lit(k)).alias(k) for k in ("k", "origin", "note")])


@query("stage_keyword_inference", "SELECT event_id, CASE WHEN lower(event_type) LIKE '%click%' THEN 'gpu' WHEN lower(event_type) LIKE '%view%' THEN 'upload' ELSE 'map' END AS stage FROM events")
def keyword_stage(spark, d):
    return table(spark, d, "events").select("event_id", tk.infer_stage(F.col("event_type"), [("click", "gpu"), ("view", "upload")], "map").alias("stage"))
