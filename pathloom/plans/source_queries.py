"""Queries that write files in the layouts of the sources, and read them back; streams over such folders."""

from __future__ import annotations

import hashlib
import io
import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import builds, files, meshes, rasters, readers, sinks
from ..sources.shared import shared_dir
from ..streaming import events as streams
from .bindings import CLOUD, EDGES, TASKS, TRAJ, cloud, edges, table, tasks, trajectory
from .catalog import query
from .kernel_queries import PLAN, _plan


#: Edges that one file of the edge folders holds, about.
EDGES_A_FILE = 100_000


def _r(df, digits=4):
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _folder(spark, name):
    """A new folder among those that all executors share, gone when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)
    return path


def _write_files(df, root, content):
    """One file for each group of df by `file`, under root: content(rows) gives its bytes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        files.put(root, rows["file"].iloc[0], content(rows))
        return rows[["file"]].head(1)

    df.groupBy("file").applyInPandas(run, "file string").write.format("noop").mode("overwrite").save()


def _npz(**arrays) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    return held.getvalue()


def _write_npz(df, root, arrays):
    """NPZ files; arrays names its columns and kinds."""
    _write_files(df, root, lambda rows: _npz(**{k: np.asarray(rows[c].tolist(), dtype) for k, (c, dtype) in arrays.items()}))


@query("pose_directory", f"WITH {CLOUD} SELECT 'run' || frame AS run, pid AS frame, round(x, 5) + 0.0 AS x, round(y, 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM cloud")
def pose_directory(spark, d):
    """One pose file a frame, in run folders."""
    root = _folder(spark, "poses")
    row = lambda *v: [F.lit(float(x)) if isinstance(x, int) else F.col(x) for x in v]
    rows = cloud(spark, d).select(F.concat(F.lit("run"), "frame", F.lit("/"), F.lpad(F.col("pid").cast("string"), 6, "0"), F.lit(".npz")).alias("file"), F.array(*row(1, 0, 0, "x")).alias("a"), F.array(*row(0, 1, 0, "y")).alias("b"), F.array(*row(0, 0, 1, "z")).alias("c"), F.array(*row(0, 0, 0, 1)).alias("e"))
    rows = rows.select("file", F.posexplode(F.array("a", "b", "c", "e")).alias("k", "pose")).repartition("file").sortWithinPartitions("file", "k")
    _write_npz(rows, root, {"pose": ("pose", "float64")})
    got = readers.poses(spark, root)
    return _r(got.select("run", "frame", *[F.col("pose")[i].alias(c) for c, i in (("x", 3), ("y", 7), ("z", 11))]), 5)


@query("edge_file_scan", f"WITH {EDGES} SELECT etype AS file, count(*) AS n, sum(i)::BIGINT AS i, sum(j)::BIGINT AS j, round(sum(conf), 4) AS conf FROM edges GROUP BY etype UNION ALL SELECT 'json', count(*), sum(i)::BIGINT, sum(j)::BIGINT, round(sum(conf), 4) FROM edges")
def edge_files(spark, d):
    """NPZ files with their contract for each type of edge, and JSON arrays, the older form.

    Their number grows with the edges, so that one file stays small.
    """
    root, old = _folder(spark, "edges"), _folder(spark, "edges-json")
    rows = edges(spark, d)
    block = F.pmod(F.xxhash64("eid"), F.lit(max(16, -(-rows.count() // EDGES_A_FILE))))
    blocks = rows.withColumn("file", F.concat("etype", F.lit("_"), block, F.lit(".npz")))
    contract = readers.EDGE_CONTRACT
    _write_files(blocks, root, lambda part: _npz(frame_i=part["i"].to_numpy(), frame_j=part["j"].to_numpy(), confidence=part["conf"].to_numpy(), edge_type=part["etype"].to_numpy(str), **contract))
    lists = rows.groupBy(block.alias("b")).agg(F.to_json(F.collect_list(F.struct(F.col("i").alias("frame_i"), F.col("j").alias("frame_j"), F.col("conf").alias("confidence"), F.col("etype").alias("edge_type")))).alias("value"))
    lists.write.partitionBy("b").text(old + "/t")
    totals = lambda df, name: df.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("i"), F.sum("j").alias("j"), F.round(F.sum("confidence"), 4).alias("conf"))
    new = totals(readers.edge_lists(spark, root, strict=True), F.col("etype"))
    return new.unionByName(totals(readers.edge_json(spark, old + "/t", "*.txt"), F.lit("json")))


@query("point_cloud_scan", f"WITH {CLOUD} SELECT 'run' || frame AS run, count(*) AS n, round(sum(x), 4) + 0.0 AS x FROM cloud GROUP BY frame")
def cloud_scan(spark, d):
    """Run folders with the usual point file beside a debug one that is empty."""
    root = _folder(spark, "clouds")
    rows = cloud(spark, d).select(F.concat(F.lit("run"), "frame").alias("run"), F.array("x", "y", "z").alias("points"))
    _write_npz(rows.select(F.concat("run", F.lit("/pointcloud.npz")).alias("file"), "points"), root, {"points": ("points", "float64")})
    _write_npz(rows.groupBy("run").agg(F.first("points").alias("points")).select(F.concat("run", F.lit("/pointcloud_full_debug.npz")).alias("file"), "points"), root, {"points": ("points", "float64")})
    return _r(readers.point_cloud(spark, root).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")))


@query("text_coordinates", f"WITH {TRAJ} SELECT id % 4 AS form, count(*) AS n, round(sum(x), 3) + 0.0 AS x, round(sum(y), 3) + 0.0 AS y, count(*) FILTER (WHERE id % 4 = 2) AS timed FROM (SELECT id, round(x, 3) AS x, y FROM traj) WHERE id % 4 < 3 GROUP BY ALL")
def text_coordinates(spark, d):
    """Lines of numbers apart by space, comma or semicolon; every fourth is no point."""
    root = _folder(spark, "text") + "/t"
    x, y, k = F.round("x", 3).cast("string"), F.col("y").cast("string"), F.col("id") % 4
    line = F.when(k == 0, F.concat(x, F.lit(" "), y)).when(k == 1, F.concat(x, F.lit(", "), y)).when(k == 2, F.concat(x, F.lit(";"), y, F.lit(" ; 7.5"))).otherwise(F.concat(x, F.lit(" nan")))
    trajectory(spark, d).select(line.alias("value"), k.alias("form")).write.partitionBy("form").text(root)
    got = readers.text_points(spark, root).withColumn("form", F.regexp_extract("path", r"form=(\d+)", 1).cast("long"))
    return _r(got.groupBy("form").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.count("t").alias("timed")), 3)


@query("route_files", f"WITH {TRAJ} SELECT run, count(*) AS n, round(sum(x), 3) + 0.0 AS x FROM traj GROUP BY run HAVING count(*) >= 2")
def route_files(spark, d):
    """JSON files with an array of points, one line each; runs of one point would be an error and aren't written."""
    root = _folder(spark, "routes") + "/t"
    rows = trajectory(spark, d).groupBy("run").agg(F.collect_list(F.struct("x", "y")).alias("points")).filter(F.size("points") >= 2)
    sinks.write_documents(rows, root, F.col("points"), "run")
    got = readers.route_lines(spark, root)
    return _r(got.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")), 3)


@query("analysis_documents", "SELECT 'video-' || c_custkey AS video_id, c_name AS name, c_custkey % 3 > 0 AS dated FROM customer WHERE c_custkey % 10 > 0")
def analysis_documents(spark, d):
    """A JSON document for each customer: every tenth without a video_id, every third without a time."""
    root = _folder(spark, "analyses")
    key = F.col("c_custkey")
    text = F.to_json(F.struct(F.when(key % 10 > 0, F.concat(F.lit("video-"), key)).otherwise(" ").alias("video_id"), F.col("c_name").alias("name"), F.when(key % 3 > 0, "2024-01-02 03:04:05").alias("uploaded_at")))
    table(spark, d, "customer").select(text.alias("value")).write.text(root + "/t")
    got = readers.analyses(spark, root + "/t", "*.txt", lines=True)
    return got.select("video_id", F.get_json_object("value", "$.name").alias("name"), (F.year("uploaded_at") == 2024).alias("dated"))


@query("upload_listing", "SELECT substr(u, 1, 36) AS video_id, length FROM (SELECT md5(n_name) AS m, length(n_name) AS length FROM nation), LATERAL (SELECT substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS u)")
def upload_listing(spark, d):
    """Files named by an identifier and _, beside others that aren't listed."""
    root = _folder(spark, "uploads")
    m = F.md5(F.col("n_name"))
    name = F.concat(F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit("_clip.mp4"))
    both = F.explode(F.array(name, F.concat(F.lit("note_"), name))).alias("file")
    _write_files(table(spark, d, "nation").select(F.col("n_name").alias("text"), both), root, lambda rows: rows["text"].iloc[0].encode())
    return readers.uploads(spark, root).select("video_id", "length")


@query("media_volumes", "SELECT 'volume' || n_regionkey AS volume, count(*) AS files, sum(length(n_name))::BIGINT AS bytes FROM nation GROUP BY n_regionkey")
def media_volumes(spark, d):
    """Clips in a folder for each region."""
    root = _folder(spark, "volumes")
    name = F.concat(F.lit("volume"), "n_regionkey", F.lit("/clips/c"), "n_nationkey")
    both = F.explode(F.array(F.concat(name, F.lit(".MP4")), F.concat(name, F.lit(".txt")))).alias("file")
    _write_files(table(spark, d, "nation").select(F.col("n_name").alias("text"), both), root, lambda rows: rows["text"].iloc[0].encode())
    return readers.volumes(spark, root).select("volume", "files", "bytes")


@query("session_defaults", f"WITH {TRAJ}, s AS (SELECT DISTINCT run FROM traj) SELECT run, CASE WHEN run % 3 = 0 THEN 'running' ELSE 'idle' END AS state, CASE WHEN run % 3 = 0 THEN run::VARCHAR ELSE '0' END AS fps FROM s")
def session_defaults(spark, d):
    """Saved states of every third session, defaults for the others."""
    root = _folder(spark, "sessions") + "/t"
    runs = trajectory(spark, d).select("run").distinct()
    sinks.write_documents(runs.filter("run % 3 = 0"), root, F.create_map(F.lit("state"), F.lit("running"), F.lit("fps"), F.col("run").cast("string")), "run")
    got = readers.session_lines(spark, root, runs, "run", {"state": "idle", "fps": "0"})
    return got.select("run", "state", "fps")


@query("candidate_write", f"WITH {CLOUD} SELECT pid, round(2 * x, 5) + 0.0 AS x FROM cloud")
def candidate_write(spark, d):
    """A candidate written beside the raw rows, over itself once, and read back."""
    root = _folder(spark, "candidates")
    for k in (1, 2):
        path = sinks.write_candidate(cloud(spark, d).select("pid", (k * F.col("x")).alias("x")), root, "robust")
    return _r(spark.read.parquet(path), 5)


@query("status_log", f"WITH {TRAJ} SELECT run, count(*) AS n, round(max(least(1, greatest(0, x / 80))), 4) + 0.0 AS progress FROM traj GROUP BY run")
def status_log(spark, d):
    """Status rows appended as JSON lines in two goes, progress kept within 0 and 1."""
    root = _folder(spark, "status") + "/t"
    rows = trajectory(spark, d).select("run", "id", (F.col("x") / 80).alias("progress"))
    for k in (0, 1):
        sinks.append_status(rows.filter(f"id % 2 = {k}"), root)
    return _r(spark.read.schema("run long, progress double").json(root).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.max("progress").alias("progress")))


@query("history_newest", f"WITH {TASKS} SELECT id, created_at FROM tasks ORDER BY created_at DESC, id DESC LIMIT 100")
def history_newest(spark, d):
    return sinks.newest(tasks(spark, d), "created_at", "id", 100).select("id", "created_at")


@query("current_analysis_runs", f"WITH {TASKS}, r AS (SELECT employee, status, max(created_at) AS started FROM tasks GROUP BY employee, status), l AS (SELECT employee, arg_max(status, struct_pack(s := started, r := status)) AS status FROM r GROUP BY employee) SELECT id FROM tasks JOIN l USING (employee, status)")
def current_runs(spark, d):
    """An employee's status stands for a run: only rows of the one begun last stay."""
    rows = tasks(spark, d)
    started = rows.groupBy("employee", "status").agg(F.max("created_at").alias("started"))
    return sinks.current_only(rows.join(started, ["employee", "status"]), "employee", "status", "started").select("id")


@query("analysis_export", f"WITH {TRAJ} SELECT run, count(*) AS points, count(*) FILTER (WHERE kind = 'purchase') AS turns, true AS ahead FROM traj GROUP BY run")
def analysis_export(spark, d):
    """Nested documents of all runs, parsed again: the pivot row lies ahead of the first."""
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).withColumn("k", F.row_number().over(w) - 1)
    docs = sinks.nested_analysis(rows.select("run", "k", "x", "y"), rows.filter("kind = 'purchase'").select("run", "k", F.col("x").alias("angle")), "run")
    kind = "trajectory_data array<struct<k:bigint,x:double,y:double>>, turn_analysis array<struct<k:bigint,angle:double>>"
    got = docs.select("run", F.from_json("document", kind).alias("a")).withColumn("p", F.element_at("a.trajectory_data", F.least(F.lit(51), F.size("a.trajectory_data"))))
    return got.select("run", F.size("a.trajectory_data").cast("long").alias("points"), F.size("a.turn_analysis").cast("long").alias("turns"), ((F.abs("p.y") <= 1e-3) & (F.col("p.x") >= 0)).alias("ahead"))


@query("run_parameters", f"WITH {TASKS}, e AS (SELECT employee, count(*) AS bridges FROM tasks WHERE status = 'O' GROUP BY employee), c AS (SELECT employee, max(size) AS best FROM tasks WHERE status = 'F' GROUP BY employee) SELECT c_custkey AS employee, coalesce(bridges, 0) AS bridges, round(coalesce(best, -1), 2) + 0.0 AS best, best IS NOT NULL AS available FROM customer LEFT JOIN e ON e.employee = c_custkey LEFT JOIN c ON c.employee = c_custkey")
def run_parameters(spark, d):
    """One row a run: its parameters, edge summary and candidate, defaults where these are missing."""
    rows = tasks(spark, d)
    bridges = rows.filter("status = 'O'").groupBy("employee").agg(F.count(F.lit(1)).alias("bridges"))
    best = rows.filter("status = 'F'").groupBy("employee").agg(F.max("size").alias("best"))
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("employee")).join(bridges, "employee", "left").join(best, "employee", "left")
    return _r(base.select("employee", F.coalesce("bridges", F.lit(0)).alias("bridges"), F.coalesce("best", F.lit(-1.0)).alias("best"), F.col("best").isNotNull().alias("available")), 2)


# -- streams


def _event_files(spark, d, name, columns):
    """The event table as JSON files in several goes, so that a stream sees more than one batch."""
    root = _folder(spark, name) + "/t"
    rows = trajectory(spark, d).select(*columns)
    for k in range(3):
        rows.filter(F.pmod("id", F.lit(3)) == k).coalesce(2).write.mode("append").json(root)
    return root


@query("stream_file_tail", f"WITH {TRAJ} SELECT run, count(*) AS n, count(DISTINCT id) AS ids FROM traj GROUP BY run")
def file_tail(spark, d):
    """New files once each, two a batch."""
    root = _event_files(spark, d, "tail", ["run", "id", "t"])
    rows = streams.replayed(streams.tail(spark, root, "run long, id long, t double", files=2), "tail-out")
    return rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@query("stream_progress", f"WITH {TRAJ} SELECT run, round(max(x), 4) + 0.0 AS x, count(*) AS updates FROM traj GROUP BY run")
def stream_progress(spark, d):
    root = _event_files(spark, d, "progress", ["run", "id", "x"])
    rows = streams.progress(streams.tail(spark, root, "run long, id long, x double", files=2), "run", "x")
    return _r(streams.replayed(rows, "progress-out", "update", latest=["run"]))


@query("stream_stage_seconds", f"WITH {TRAJ}, c AS (SELECT run, kind, t, lag(kind) OVER (PARTITION BY run ORDER BY t, kind) AS was FROM traj), s AS (SELECT run, kind, t, lead(t) OVER (PARTITION BY run ORDER BY t, kind) AS till FROM c WHERE was IS NULL OR was <> kind) SELECT run::VARCHAR AS run, kind AS stage, round(sum(till - t), 3) + 0.0 AS seconds, count(*) AS visits FROM s WHERE till IS NOT NULL GROUP BY run, kind")
def stream_stages(spark, d):
    root = _folder(spark, "stages") + "/t"
    trajectory(spark, d).select("run", "t", F.col("kind").alias("stage")).repartition(4, "run").write.json(root)
    rows = streams.stage_seconds(streams.tail(spark, root, "run long, t double, stage string", files=1))
    return _r(streams.replayed(rows, "stages-out", "update", latest=["run", "stage"]), 3)


@query("stream_json_events", f"WITH {TRAJ} SELECT kind AS event, count(*) AS n, sum(id)::BIGINT AS ids FROM traj GROUP BY kind")
def stream_events(spark, d):
    """JSON lines of events, with lines that are none between them."""
    root = _folder(spark, "lines") + "/t"
    good = F.to_json(F.struct(F.col("kind").alias("event"), F.create_map(F.lit("id"), F.col("id").cast("string")).alias("data")))
    trajectory(spark, d).select(F.explode(F.array(good, F.lit("no event"), F.lit("{}"))).alias("value")).write.text(root)
    rows = streams.replayed(streams.json_events(spark, root), "lines-out")
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("data")["id"].cast("long")).alias("ids"))


@query("mesh_cloud", f"WITH {CLOUD} SELECT frame % 2 = 0 AS ply, frame, count(*) AS n, round(sum(x), 4) + 0.0 AS x, round(sum(z), 4) + 0.0 AS z, round(sum(conf), 4) + 0.0 AS conf FROM cloud GROUP BY ALL")
def mesh_cloud(spark, d):
    """A PLY file for each frame, in either byte order, read by ranges."""
    root = _folder(spark, "meshes")
    rows = cloud(spark, d).select(F.concat(F.lit("frame"), "frame", F.lit(".ply")).alias("file"), "frame", "x", "y", "z", "conf")
    _write_files(rows, root, lambda part: meshes.ply_bytes(part[["x", "y", "z"]].to_numpy(), None, part["conf"].to_numpy(), "<" if part["frame"].iloc[0] % 2 == 0 else ">"))
    got = meshes.clouds(spark, root).withColumn("frame", F.regexp_extract("path", r"frame(-?\d+)\.ply", 1).cast("int"))
    return _r(got.groupBy("frame", (F.col("frame") % 2 == 0).alias("ply")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("z").alias("z"), F.sum("conf").alias("conf")))


@query("raster_plan", f"WITH {PLAN} SELECT 'plan' || map AS map_id, cx // 2 AS cx, cy // 2 AS cy, bool_or(occupied) AS occupied FROM plan GROUP BY ALL")
def raster_plan(spark, d):
    """Each plan as a PNG mask beside its description, read back against its digest."""
    root = _folder(spark, "plans")

    def picture(rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((int(rows["cy"].max()) + 1, int(rows["cx"].max()) + 1), np.uint8)
        out[rows["cy"], rows["cx"]] = np.where(rows["occupied"], 200, 40)
        return out

    def described(rows: pd.DataFrame) -> bytes:
        luma, name = picture(rows), f"plan{rows['map'].iloc[0]}"
        digest = hashlib.sha256(rasters.png_bytes(luma)).hexdigest()
        return json.dumps({"map_id": name, "width": luma.shape[1], "height": luma.shape[0], "grid_cell_pixels": 2, "obstacle_mask_file": f"{name}.png", "obstacle_mask_sha256": digest}).encode()

    cells = _plan(spark, d).withColumn("file", F.explode(F.array(*[F.concat(F.lit("plan"), "map", F.lit(k)) for k in (".png", ".json")])))
    _write_files(cells, root, lambda rows: rasters.png_bytes(picture(rows)) if rows["file"].iloc[0].endswith("png") else described(rows))
    return rasters.plan_cells(spark, root)


@query("build_resumed", f"WITH {TRAJ} SELECT run, count(*) AS n, round(sum(x), 3) + 0.0 AS x FROM traj GROUP BY run")
def build_resumed(spark, d):
    """A build that stops after two of its five parts and is taken up again."""
    root = _folder(spark, "build")
    make = lambda own: own.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))
    builds.resumed(trajectory(spark, d), "run", make, root, 5, most=2)
    return _r(builds.resumed(trajectory(spark, d), "run", make, root, 5), 3)


@query("artefact_recovery", f"""WITH {TRAJ}, k AS (SELECT run, id, row_number() OVER (PARTITION BY run ORDER BY t, id) AS frame FROM traj), f AS (SELECT run, frame FROM k WHERE NOT (run % 5 = 1 AND frame = 9) AND run % 3 <> 0),
    s AS (SELECT run, count(*) AS frames, min(frame) AS first, max(frame) AS last FROM f GROUP BY run) SELECT *, CASE WHEN frames < 60 THEN 'lost' WHEN last - first + 1 = frames THEN 'complete' ELSE 'partial' END AS state FROM s""")
def artefact_recovery(spark, d):
    """Runs whose results are missing, by the frames they have left."""
    w = Window.partitionBy("run").orderBy("t", "id")
    frames = trajectory(spark, d).select("run", F.row_number().over(w).cast("long").alias("frame")).filter(~((F.col("run") % 5 == 1) & (F.col("frame") == 9)))
    return builds.recovered(frames, trajectory(spark, d).filter("run % 3 = 0").select("run"), "run", 60)


@query("candidate_selection", f"""WITH {TRAJ}, n AS (SELECT run, count(*) AS n FROM traj GROUP BY run), c AS (SELECT * FROM (VALUES (0, 'pose_graph'), (1, 'scale_aware')) v(p, candidate)),
    a AS (SELECT run, n, p, candidate, CASE WHEN candidate = 'pose_graph' THEN CASE WHEN run % 7 = 0 THEN 0 WHEN run % 5 = 0 THEN n - 1 ELSE n END ELSE CASE WHEN run % 11 = 0 THEN 0 ELSE n END END AS frames, run % (p + 2) = 0 AS accepted FROM n, c),
    s AS (SELECT *, CASE WHEN frames = 0 THEN 'missing' WHEN NOT accepted THEN 'not_accepted' WHEN frames <> n THEN 'frame_count' ELSE 'ok' END AS state FROM a)
    SELECT run, coalesce(arg_min(candidate, p) FILTER (WHERE state = 'ok'), 'raw') AS candidate, max(state) FILTER (WHERE p = 0) AS pose_graph, max(state) FILTER (WHERE p = 1) AS scale_aware FROM s GROUP BY run""")
def candidate_selection(spark, d):
    """Of two candidates written beside the raw data, the first that is whole and accepted."""
    root = _folder(spark, "candidates")
    w = Window.partitionBy("run").orderBy("t", "id")
    rows = trajectory(spark, d).select("run", F.row_number().over(w).alias("frame"), "x", "y")
    last = F.max("frame").over(Window.partitionBy("run"))
    sinks.write_candidate(rows.withColumn("last", last).filter("run % 7 <> 0 and (run % 5 <> 0 or frame < last)").drop("last"), root, "pose_graph")
    sinks.write_candidate(rows.filter("run % 11 <> 0"), root, "scale_aware")
    runs = rows.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    said = runs.select("run", F.explode(F.array(*[F.struct(F.lit(c).alias("candidate"), (F.col("run") % m == 0).alias("accepted")) for c, m in (("pose_graph", 2), ("scale_aware", 3))])).alias("s")).select("run", "s.*")
    return readers.chosen_candidates(spark.read.parquet(root), said, runs, ["pose_graph", "scale_aware"])


_KEPT = f"{CLOUD}, k AS (SELECT *, row_number() OVER (ORDER BY frame, pid) - 1 AS pos FROM cloud WHERE conf >= -0.1), t AS (SELECT * FROM k WHERE pos % 3 = 0), s AS (SELECT greatest(1, ceil(count(*) / 90.0))::BIGINT AS step FROM t), c AS (SELECT t.*, step FROM t, s WHERE (pos // 3) % step = 0)"


@query("parity_export", f"WITH {_KEPT} SELECT (SELECT count(*) FROM cloud) AS before, count(*) AS after, round(avg(conf), 5) + 0.0 AS mean_conf, {', '.join(f'round({n}({a}), 5) + 0.0 AS {n}_{a}' for a in 'xyz' for n in ('min', 'max'))}, 3 * any_value(step) AS step FROM c")
def parity_export(spark, d):
    """A thinned cloud beside its report, which is read back."""
    root = _folder(spark, "parity")
    points = cloud(spark, d).select("frame", "pid", "x", "y", "z", "conf")
    sinks.export_cloud(points, root, -0.1, 3, 90)
    numbers = ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max"))
    return _r(spark.read.schema(f"before long, after long, mean_conf double, {numbers}, step long").json(f"{root}/report"), 5)
