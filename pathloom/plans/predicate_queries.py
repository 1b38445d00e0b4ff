"""Queries of loose parsing, compatibility rules and single-row projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import predicates as p
from ..operators import series as s
from .bindings import CLOUD, EDGES, TASKS, TRAJ, cloud, edges, table, tasks, trajectory
from .catalog import query
from .series_queries import _round


def _r(df, digits=4):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query(
    "point_parse",
    f"""WITH {TRAJ}, v AS (SELECT id, round(x, 3) AS x, y FROM traj),
    k AS (SELECT id, [CASE WHEN id % 5 < 3 THEN struct_pack(x := x, y := y) END, struct_pack(x := y, y := 1.0::DOUBLE)] AS ps FROM v),
    f AS (SELECT id, list_filter(ps, lambda q: q IS NOT NULL) AS ps FROM k)
    SELECT id, len(ps)::INT AS n, round(ps[1].x, 3) + 0.0 AS x, round(ps[1].y, 3) + 0.0 AS y FROM f""",
)
def point_parse(spark, d):
    x, y = F.round("x", 3).cast("string"), F.col("y").cast("string")
    form = F.when(F.col("id") % 5 == 0, F.concat(F.lit("["), x, F.lit(","), y, F.lit("]"))).when(F.col("id") % 5 == 1, F.concat(F.lit('{"x":'), x, F.lit(',"y":'), y, F.lit("}")))
    form = form.when(F.col("id") % 5 == 2, F.concat(F.lit('{"position":['), x, F.lit(","), y, F.lit("]}"))).when(F.col("id") % 5 == 3, F.lit('{"x":"far","y":1}')).otherwise(F.lit("[1]"))
    text = F.concat(F.lit("["), form, F.lit(',"junk",{"position":{"x":'), y, F.lit(',"y":1}}]'))
    rows = trajectory(spark, d).select("id", p.json_points(text).alias("ps"))
    return _r(rows.select("id", F.size("ps").alias("n"), F.col("ps")[0]["x"].alias("x"), F.col("ps")[0]["y"].alias("y")), 3)


_RAW = "CASE id % 5 WHEN 0 THEN x::VARCHAR WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN '-7' ELSE '1e3' END"


@query("safe_numbers", f"WITH {TRAJ}, v AS (SELECT id, TRY_CAST({_RAW} AS DOUBLE) AS v FROM traj) SELECT id, round(least(100, greatest(0, CASE WHEN v IS NULL OR isnan(v) THEN 50 ELSE v END)), 4) + 0.0 AS v FROM v")
def safe_numbers(spark, d):
    raw = F.when(F.col("id") % 5 == 0, F.col("x").cast("string")).when(F.col("id") % 5 == 1, "nan").when(F.col("id") % 5 == 2, "").when(F.col("id") % 5 == 3, "-7").otherwise("1e3")
    return _r(trajectory(spark, d).select("id", p.number(raw, 50.0, 0.0, 100.0).alias("v")))


@query("sampling_contract", "SELECT p_partkey, (p_size % 4 = 2 AND coalesce(CASE WHEN p_size <> 7 THEN 300 END, 0) = 300 AND p_size > 10 AND (p_partkey % 2 = 0 OR abs(p_retailprice - round(p_retailprice)) <= 1e-9)) AS matches FROM part")
def sampling_contract(spark, d):
    saved = {"stride": F.col("p_size") % 4, "frames": F.when(F.col("p_size") != 7, 300), "size": F.when(F.col("p_size") > 10, 518).otherwise(224), "long": F.col("p_partkey") % 2 != 0, "fps": F.col("p_retailprice")}
    return table(spark, d, "part").select("p_partkey", p.sampling_matches(saved, F.lit(2), F.lit(300), F.lit(518), F.round("p_retailprice")).alias("matches"))


@query(
    "fragmentation",
    """WITH c AS (SELECT o_custkey AS k, count(DISTINCT o_orderstatus) AS a, count(DISTINCT o_orderpriority) AS b, count(*) FILTER (WHERE o_orderstatus = 'O') AS part, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT k, (greatest(a, b) >= 4 OR least(1.0::DOUBLE, part / n) < 0.45) AS fragmented FROM c""",
)
def fragmentation(spark, d):
    per = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.countDistinct("o_orderstatus").alias("a"), F.countDistinct("o_orderpriority").alias("b"), F.count_if(F.col("o_orderstatus") == "O").alias("part"), F.count(F.lit(1)).alias("n"))
    return per.select("k", p.fragmented([F.col("a"), F.col("b")], [F.lit(None).cast("double")], F.col("part"), F.col("n")).alias("fragmented"))


_POLICY = "CASE WHEN s_suppkey % 3 = 0 THEN 'authoritative' ELSE 'independent' END"


@query(
    "plausible_speed",
    f"""WITH v AS (SELECT s_suppkey, s_acctbal / 4000.0::DOUBLE AS ratio, CASE WHEN s_suppkey % 7 > 0 THEN (s_suppkey % 7) * 150.0 END AS sec, {_POLICY} AS policy, s_nationkey % 2 = 0 AS loop FROM supplier)
    SELECT s_suppkey, CASE WHEN sec IS NULL THEN policy <> 'independent' WHEN policy <> 'independent' THEN ratio BETWEEN {p.SPEED_BOUNDS['authoritative'][0]} AND {p.SPEED_BOUNDS['authoritative'][1]}
    WHEN sec >= 600 THEN ratio BETWEEN 0.04 AND 1.80 WHEN loop THEN ratio BETWEEN 0.55 AND 1.80 ELSE ratio BETWEEN 0.72 AND 1.80 END AS plausible FROM v""",
)
def plausible(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 4000.0).alias("ratio"), F.when(F.col("s_suppkey") % 7 > 0, F.col("s_suppkey") % 7 * 150.0).alias("sec"), F.when(F.col("s_suppkey") % 3 == 0, "authoritative").otherwise("independent").alias("policy"), (F.col("s_nationkey") % 2 == 0).alias("loop"))
    return rows.select("s_suppkey", p.plausible_speed(F.col("ratio"), F.col("sec"), F.col("policy"), F.col("loop")).alias("plausible"))


_LABEL = "CASE {0} % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'robust_candidate' WHEN 2 THEN 'scale_aware_candidate' ELSE ' ' END"


def _label(c):
    return F.when(c % 4 == 0, "raw").when(c % 4 == 1, "robust_candidate").when(c % 4 == 2, "scale_aware_candidate").otherwise(" ")


@query(
    "source_compatibility",
    f"""WITH v AS (SELECT c_custkey, c_acctbal > 0 AS ok, {_LABEL.format('c_custkey')} AS req, {_LABEL.format('c_nationkey')} AS saved, CASE WHEN c_custkey % 3 > 0 THEN {_LABEL.format('(c_custkey // 3)')} END AS want FROM customer)
    SELECT c_custkey, ok AND (saved = ' ' OR req = ' ' OR req = saved OR coalesce(want <> ' ' AND req = want, false)) AS restore FROM v""",
)
def compatibility(spark, d):
    c = table(spark, d, "customer")
    want = F.when(F.col("c_custkey") % 3 > 0, _label(F.floor(F.col("c_custkey") / 3)))
    return c.select("c_custkey", F.coalesce(p.may_restore(F.col("c_acctbal") > 0, _label(F.col("c_custkey")), _label(F.col("c_nationkey")), want), F.lit(False)).alias("restore"))


@query("stale_runs", f"WITH {TASKS}, n AS (SELECT employee, max(CASE WHEN status <> 'P' THEN id END) AS now FROM tasks GROUP BY employee) SELECT id, (status = 'P' OR now IS NULL OR id = now) AS current FROM tasks JOIN n USING (employee)")
def stale_runs(spark, d):
    rows = tasks(spark, d).select("id", "employee", F.when(F.col("status") != "P", F.col("id")).alias("of"))
    now = rows.groupBy("employee").agg(F.max("of").alias("now"))
    return rows.join(now, "employee").select("id", p.current_run(F.col("of"), F.col("now")).alias("current"))


@query(
    "clock_validity",
    f"""WITH {TRAJ}, k AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY t, id) AS k, CASE WHEN id % 4 > 0 THEN round(t) END AS c FROM traj),
    n AS (SELECT run FROM k GROUP BY run HAVING count(c) >= 2),
    a AS (SELECT k.*, last_value(c IGNORE NULLS) OVER w AS ca, last_value(CASE WHEN c IS NOT NULL THEN k END IGNORE NULLS) OVER w AS ka, first_value(c IGNORE NULLS) OVER v AS cb, first_value(CASE WHEN c IS NOT NULL THEN k END IGNORE NULLS) OVER v AS kb
      FROM k JOIN n USING (run) WINDOW w AS (PARTITION BY run ORDER BY k ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY run ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT run, id, k, coalesce(c, ca + (cb - ca) * (k - ka) / nullif(kb - ka, 0), ca, cb) AS t FROM a),
    s AS (SELECT *, t - lag(t) OVER (PARTITION BY run ORDER BY k) AS step FROM f), ok AS (SELECT run FROM s GROUP BY run HAVING min(step) > 0)
    SELECT run, id, round(t, 3) + 0.0 AS t FROM f SEMI JOIN ok USING (run)""",
)
def clock_validity(spark, d):
    rows = trajectory(spark, d).select("run", "id", "t")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("t", "id"))).withColumn("t", F.when(F.col("id") % 4 > 0, F.round("t")))
    return _r(p.valid_clocks(rows, "run", "k", "t").select("run", "id", "t"), 3)


@query(
    "source_fallback",
    """WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'robust_candidate' WHEN 2 THEN 'scale_aware_candidate' ELSE 'other' END AS req, o_custkey % 2 = 0 AS sa, o_custkey % 3 = 0 AS sc, o_custkey % 5 > 0 AS ra, o_custkey % 7 > 0 AS rc,
      CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 13 > 0 END AS fresh, o_custkey % 17 > 0 AS valid FROM orders),
    r AS (SELECT *, CASE WHEN NOT ra THEN 'candidate_unavailable' WHEN NOT rc THEN 'candidate_rejected' WHEN fresh IS NULL THEN 'source_graph_missing' WHEN NOT fresh THEN 'candidate_stale' WHEN NOT valid THEN 'candidate_artifact_invalid' END AS why FROM v)
    SELECT o_orderkey, CASE WHEN req = 'scale_aware_candidate' AND sa AND sc THEN req WHEN req IN ('scale_aware_candidate', 'robust_candidate') AND why IS NULL THEN 'robust_candidate' ELSE 'raw' END AS selected,
      CASE WHEN req = 'other' THEN 'unsupported_source' WHEN req = 'scale_aware_candidate' AND NOT (sa AND sc) THEN CASE WHEN sa THEN 'scale_candidate_rejected' ELSE 'scale_candidate_unavailable' END WHEN req = 'robust_candidate' THEN why END AS reason FROM r""",
)
def fallback(spark, d):
    c, key = F.col("o_custkey"), F.col("o_orderkey")
    requested = F.when(key % 4 == 0, "raw").when(key % 4 == 1, "robust_candidate").when(key % 4 == 2, "scale_aware_candidate").otherwise("other")
    robust = {"available": c % 5 > 0, "accepted": c % 7 > 0, "fresh": F.when(c % 11 > 0, c % 13 > 0), "valid": c % 17 > 0}
    chosen = p.source_choice(requested, {"available": c % 2 == 0, "accepted": c % 3 == 0}, robust)
    return table(spark, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in chosen.items()])


@query(
    "confidence_lookup",
    f"""WITH {TRAJ}, o AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY t, id) - 1 AS k FROM traj), v AS (SELECT run, key, CASE WHEN key % 3 = 0 THEN NULL ELSE x END AS value FROM (SELECT run, id % 40 AS key, min(x) AS x FROM traj GROUP BY ALL))
    SELECT o.run, o.id, round(coalesce(a.value, b.value), 4) + 0.0 AS conf FROM o LEFT JOIN v a ON a.run = o.run AND a.key = o.id LEFT JOIN v b ON b.run = o.run AND b.key = o.k""",
)
def confidence_lookup(spark, d):
    rows = trajectory(spark, d)
    values = rows.groupBy("run", (F.col("id") % 40).alias("key")).agg(F.min("x").alias("value")).withColumn("value", F.when(F.col("key") % 3 == 0, float("nan")).otherwise(F.col("value")))
    numbered = rows.select("run", "id", F.struct("t", "id").alias("at"))
    out = p.known_or_ordinal(numbered, values, "run", "id", "at", "conf").select("run", "id", F.nanvl("conf", F.lit(None).cast("double")).alias("conf"))
    return _r(out)


@query(
    "frame_source_index",
    f"""WITH {TRAJ}, k AS (SELECT run, id, t, row_number() OVER (PARTITION BY run ORDER BY t, id) - 1 AS k FROM traj), l AS (SELECT run, list(id ORDER BY t, id) AS ids, list(t ORDER BY t, id) AS ts FROM traj WHERE id % 2 = 0 GROUP BY run)
    SELECT k.run, k.id, CASE WHEN k < len(ids) THEN ids[k + 1] END AS source, round(CASE WHEN k < len(ids) THEN ts[k + 1] END, 3) + 0.0 AS at FROM k LEFT JOIN l USING (run)""",
)
def source_index(spark, d):
    rows = trajectory(spark, d).select("run", "id", "t").withColumn("k", F.row_number().over(Window.partitionBy("run").orderBy("t", "id")) - 1)
    lists = rows.filter("id % 2 = 0").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("l")).select("run", F.col("l.id").alias("ids"), F.col("l.t").alias("ts"))
    return _r(p.at_positions(rows, lists, "run", "k", {"ids": "source", "ts": "at"}).select("run", "id", "source", "at"), 3)


@query("pose_time", f"WITH {TRAJ} SELECT id, round(CASE id % 4 WHEN 0 THEN y WHEN 1 THEN y + 1 WHEN 2 THEN y + 2 ELSE id / 30.0::DOUBLE END, 4) + 0.0 AS t, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM traj")
def pose_time(spark, d):
    name = F.when(F.col("id") % 4 == 0, "timestamp").when(F.col("id") % 4 == 1, "time_seconds").when(F.col("id") % 4 == 2, "t").otherwise("other")
    text = F.concat(F.lit('{"'), name, F.lit('":'), (F.col("y") + F.col("id") % 4).cast("string"), F.lit("}"))
    stamp = F.coalesce(p.first_key(text, "timestamp", "timestamp_seconds", "time_seconds", "t"), F.col("id") / 30.0)
    return _r(trajectory(spark, d).select("id", stamp.alias("t"), "x", "y"))


@query("uniform_recovery", f"WITH {TRAJ}, k AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY t, id) - 1 AS p FROM traj), n AS (SELECT run, count(*) AS n FROM k GROUP BY run), w AS (SELECT run, unnest(range(least(12, n))) AS k, n FROM n), q AS (SELECT run, k, round_even(k * (n - 1) / greatest(1, least(12, n) - 1)::DOUBLE, 0)::BIGINT AS want FROM w) SELECT q.run, q.k::INT AS k, want, max(p) AS taken FROM q JOIN k ON k.run = q.run AND p BETWEEN want - 2 AND want WHERE id % 3 > 0 GROUP BY q.run, q.k, want")
def recovery(spark, d):
    rows = trajectory(spark, d).select("run", "id", "t").withColumn("p", F.row_number().over(Window.partitionBy("run").orderBy("t", "id")) - 1)
    return p.linspace_rows(rows, "run", "p", 12, F.col("id") % 3 > 0, 2)


@query("context_flags", "SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k, json_extract_string(props, '$.plan') IS NOT NULL AS has_plan, coalesce(json_extract_string(props, '$.k'), '') AS k FROM events")
def context_flags(spark, d):
    context = p.json_or_empty(F.col("props"))
    has = lambda k: F.try_element_at(context, F.lit(k)).isNotNull()
    return table(spark, d, "events").select("event_id", has("k").alias("has_k"), has("plan").alias("has_plan"), F.coalesce(F.try_element_at(context, F.lit("k")), F.lit("")).alias("k"))


@query("registry_documents", "SELECT event_id, CASE WHEN event_id % 6 > 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 6 > 0 THEN coalesce(json_extract_string(props, '$.floorplan_id'), 'plan-' || event_type) ELSE 'plan-' || event_type END AS floorplan_id FROM events ORDER BY ts DESC, event_id")
def registry_documents(spark, d):
    """Rows with a JSON column: bad JSON reads as empty, a missing key gets its default, newest first."""
    rows = table(spark, d, "events").withColumn("context", F.when(F.col("event_id") % 6 > 0, F.col("props")).otherwise(F.lit("{broken")))
    context = p.json_or_empty(F.col("context"))
    plan = F.coalesce(F.try_element_at(context, F.lit("floorplan_id")), F.concat(F.lit("plan-"), "event_type"))
    return rows.orderBy(F.desc("ts"), "event_id").select("event_id", F.try_element_at(context, F.lit("k")).alias("k"), plan.alias("floorplan_id"))


@query("turn_positions", f"WITH {CLOUD} SELECT pid, CASE WHEN frame % 3 > 0 THEN [round(x, 5), round(y, 5), CASE WHEN frame % 2 = 0 THEN round(z, 5) ELSE 0 END] ELSE [0.0::DOUBLE, 0, 0] END AS position FROM cloud")
def turn_positions(spark, d):
    place = F.when(F.col("frame") % 3 > 0, F.struct(_round("x", 5).alias("x"), _round("y", 5).alias("y"), F.when(F.col("frame") % 2 == 0, _round("z", 5)).alias("z")))
    return cloud(spark, d).withColumn("at", place).select("pid", F.array(*[F.coalesce(F.col(f"at.{c}"), F.lit(0.0)) for c in "xyz"]).alias("position"))


@query("trajectory_normalise", f"WITH {CLOUD} SELECT pid, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(CASE WHEN frame % 2 = 0 THEN conf WHEN frame % 3 = 0 THEN z ELSE 0 END, 5) + 0.0 AS heading_deg FROM cloud")
def normalise(spark, d):
    rows = cloud(spark, d).withColumn("heading", F.when(F.col("frame") % 2 == 0, F.col("conf"))).withColumn("z", F.when(F.col("frame") % 3 == 0, F.col("z")))
    return _r(rows.select("pid", "x", "y", F.coalesce("heading", "z", F.lit(0.0)).alias("heading_deg")), 5)


@query("flip_vertical", f"WITH {CLOUD} SELECT pid, round(x, 8) + 0.0 AS x, round(-y, 8) + 0.0 AS y FROM cloud")
def flip(spark, d):
    return _r(cloud(spark, d).select("pid", "x", (-F.col("y")).alias("y")), 8)


@query("yaw_sign_weight", f"WITH {CLOUD} SELECT pid, CASE WHEN abs(x) < 0.01 THEN 1 WHEN (x > 0) = (frame % 2 = 0) THEN -1 ELSE 1 END AS sign, round(greatest(0.05::DOUBLE, conf) + CASE WHEN frame > 4 THEN 0.2::DOUBLE ELSE 0 END, 6) AS weight FROM cloud")
def yaw_sign(spark, d):
    """A known right turn seen as a positive yaw flips the sign; essential observations weigh 0.2 more."""
    sign = F.when(F.abs("x") < 0.01, 1).when((F.col("x") > 0) == (F.col("frame") % 2 == 0), -1).otherwise(1)
    return _r(cloud(spark, d).select("pid", sign.alias("sign"), (F.greatest(F.lit(0.05), "conf") + F.when(F.col("frame") > 4, 0.2).otherwise(0.0)).alias("weight")), 6)


@query("scale_estimates", f"WITH {TRAJ}, s AS (SELECT run, x, y, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM traj WINDOW w AS (PARTITION BY run ORDER BY t, id)) SELECT run, round(25.0 / nullif(sum(step), 0), 8) + 0.0 AS by_distance, round(1.7 / nullif(max(y), 0), 8) + 0.0 AS by_height, round(2.4 / nullif(max(x * 0.6 + y * 0.8) - min(x * 0.6 + y * 0.8), 0), 8) + 0.0 AS by_width FROM s GROUP BY run")
def scales(spark, d):
    """Metres a unit by a known distance, a person's height, and a corridor's width across its direction."""
    across = F.col("x") * 0.6 + F.col("y") * 0.8
    got = s.steps(trajectory(spark, d)).groupBy("run").agg(F.sum("step").alias("n"), F.max("y").alias("h"), (F.max(across) - F.min(across)).alias("w"))
    per = lambda size, c: size / F.nullif(F.col(c), F.lit(0.0))
    return _r(got.select("run", per(25.0, "n").alias("by_distance"), per(1.7, "h").alias("by_height"), per(2.4, "w").alias("by_width")), 8)


_Q3 = "1 - 2*(y*y + z*z) AS a0, 2*(x*y - z*w) AS a1, 2*(x*z + y*w) AS a2, 2*(x*y + z*w) AS b0, 1 - 2*(x*x + z*z) AS b1, 2*(y*z - x*w) AS b2, 2*(x*z - y*w) AS c0, 2*(y*z + x*w) AS c1, 1 - 2*(x*x + y*y) AS c2"


@query(
    "pose_similarity",
    f"WITH {CLOUD}, q AS (SELECT pid, x / n AS x, y / n AS y, z / n AS z, r / n AS w, g, b, conf FROM (SELECT *, sqrt(x*x + y*y + z*z + r*r) AS n FROM cloud)), m AS (SELECT pid, g, b, conf, {_Q3} FROM q) SELECT pid, round(-b0, 6) + 0.0 AS r00, round(a1, 6) + 0.0 AS r11, round(c2, 6) + 0.0 AS r22, round(2.5 * -b + 1, 6) + 0.0 AS tx, round(2.5 * g - 2, 6) + 0.0 AS ty, round(2.5 * conf + 3, 6) + 0.0 AS tz FROM m",
)
def pose_similarity(spark, d):
    rows = cloud(spark, d).withColumns(g.quaternion_matrix(F.col("x"), F.col("y"), F.col("z"), F.col("r"))).withColumns({"tx": F.col("g"), "ty": F.col("b"), "tz": F.col("conf")})
    turn = ((0.0, -1.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0))
    return _r(rows.select("pid", *[c.alias(n) for n, c in g.similarity_pose(turn, 2.5, (1.0, -2.0, 3.0)).items() if n in ("r00", "r11", "r22", "tx", "ty", "tz")]), 6)


@query("initial_heading", f"WITH {TRAJ}, s AS (SELECT run, t, id, x, y, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) AS step FROM traj WINDOW w AS (PARTITION BY run ORDER BY t, id)), a AS (SELECT *, sum(step) OVER (PARTITION BY run ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS arc, sum(step) OVER (PARTITION BY run) AS total FROM s), f AS (SELECT run, first(x ORDER BY t, id) AS x0, first(y ORDER BY t, id) AS y0, arg_min(x, struct_pack(t := t, id := id)) FILTER (WHERE arc >= 0.025 * total AND arc > 0) AS x1, arg_min(y, struct_pack(t := t, id := id)) FILTER (WHERE arc >= 0.025 * total AND arc > 0) AS y1 FROM a GROUP BY run) SELECT run, round(degrees(atan2(y1 - y0, x1 - x0)), 4) + 0.0 AS heading FROM f WHERE x1 IS NOT NULL")
def initial_heading(spark, d):
    """Direction from the first row to the row where the first fortieth of the length is done."""
    rows = s.arc_fraction(trajectory(spark, d))
    at = F.struct("t", "id")
    ends = rows.groupBy("run").agg(F.min_by(F.struct("x", "y"), at).alias("a"), F.min_by(F.when((F.col("fraction") >= 0.025) & (F.col("arc") > 0), F.struct("x", "y")), F.when((F.col("fraction") >= 0.025) & (F.col("arc") > 0), at)).alias("b"))
    return _r(ends.filter("b is not null").select("run", F.degrees(F.atan2(F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x"))).alias("heading")))


@query("run_profile", f"WITH {EDGES}, e AS (SELECT etype, count(*) AS n, count(*) FILTER (WHERE abs(j - i) > 10) AS long FROM edges GROUP BY etype), {TRAJ}, k AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY t, id) AS a, row_number() OVER (PARTITION BY run ORDER BY t DESC, id DESC) AS b FROM traj) SELECT 'edges ' || etype AS part, n, long AS detail FROM e UNION ALL SELECT 'ends', count(*), sum(id)::BIGINT FROM k WHERE a <= 3 OR b <= 3")
def run_profile(spark, d):
    """Edge counts by type, and the first and last three poses of every run."""
    per = edges(spark, d).groupBy("etype").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs(F.col("j") - F.col("i")) > 10).alias("detail"))
    rows = trajectory(spark, d).select("run", "id", "t")
    up, down = Window.partitionBy("run").orderBy("t", "id"), Window.partitionBy("run").orderBy(F.desc("t"), F.desc("id"))
    ends = rows.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)}).filter("a <= 3 or b <= 3")
    return per.select(F.concat(F.lit("edges "), "etype").alias("part"), "n", "detail").union(ends.agg(F.lit("ends").alias("part"), F.count(F.lit(1)), F.sum("id")))
