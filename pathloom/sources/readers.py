"""Readers of pose, edge, cloud, JSON, text and media folders, all by Spark's file sources.

NPZ files come through `binaryFile`, so Spark lists, splits and retries; a task
opens one file at a time. Unreadable files are skipped, as half-written ones
are; a caller that must know counts the paths.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import json_or_empty, json_points, number

#: Keys under which files hold poses, and which of them are world to camera.
POSE_KEYS = ("extrinsic", "trajectory", "poses", "camera_poses", "extrinsics", "pred_cam", "camera", "cam_T_world", "world_T_cam", "pose")
INVERTED = ("cam_T_world",)
#: Metadata that an edge file must carry to be read strictly.
EDGE_CONTRACT = {
    "schema_version": 1,
    "pose_encoding": "txyz_qxyzw_fovxy",
    "transform_convention": "target_hmat=relative_hmat@reference_hmat",
    "frame_index_space": "exported_camera_index",
    "absolute_pose_space": "world_to_camera",
    "confidence_semantics": "softplus_positive_weight_not_covariance",
}
MEDIA = ("mp4", "mov", "avi", "mkv", "webm", "m4v", "mts", "m2ts", "3gp", "insv")


def _files(spark: SparkSession, path: str, pattern: str, recursive: bool = False) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return (reader.option("recursiveFileLookup", "true") if recursive else reader).load(path)


def _opened(content: bytes) -> dict | None:
    """The arrays of an NPZ file's bytes, None where it can't be read."""
    try:
        with np.load(io.BytesIO(content), allow_pickle=False) as held:
            return {k: held[k] for k in held.files}
    except Exception:  # a damaged file raises whatever its damage hits
        return None


def poses(spark: SparkSession, path: str) -> DataFrame:
    """(run, frame, pose array<double> of 16, source) of NPZ files in run folders.

    The first of POSE_KEYS with finite 4 x 4 or 3 x 4 matrices counts; a file
    with one matrix is the frame its name says, a stack numbers its own. World
    to camera matrices are inverted.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = _opened(content)
                key = next((k for k in POSE_KEYS if held is not None and k in held and held[k].ndim in (2, 3) and held[k].shape[-2:] in ((3, 4), (4, 4))), None)
                if key is None:
                    continue
                m = held[key].astype(float)
                m = m[None] if m.ndim == 2 else m
                full = np.tile(np.eye(4), (len(m), 1, 1))
                full[:, : m.shape[1]] = m
                name, folder = path.rsplit("/", 1)[1].rsplit(".", 1)[0], path.rsplit("/", 2)[1]
                first = int(name) if len(m) == 1 and name.isdigit() else 0
                for k, p in enumerate(full):
                    if np.isfinite(p).all():
                        if key in INVERTED:
                            p[:3, 3], p[:3, :3] = -p[:3, :3].T @ p[:3, 3], p[:3, :3].T.copy()
                        rows.append((folder, first + k, p.reshape(-1).tolist(), key))
            yield pd.DataFrame(rows, columns=["run", "frame", "pose", "source"])

    return _files(spark, path, "*.npz", True).select("path", "content").mapInPandas(run, "run string, frame long, pose array<double>, source string")


def edge_lists(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, i, j, confidence, etype) of NPZ edge files (frame_i, frame_j, confidence, edge_type).

    strict raises where a file's metadata are not those of EDGE_CONTRACT.
    """
    contract = EDGE_CONTRACT

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                held = _opened(content)
                if strict:
                    wrong = sorted(k for k, v in contract.items() if held is None or k not in held or held[k].item() != v)
                    if wrong:
                        raise ValueError(f"{path}: {', '.join(wrong)} differ from the contract")
                if held is None or not {"frame_i", "frame_j"} <= set(held):
                    continue
                n = len(held["frame_i"])
                yield pd.DataFrame({"path": path, "i": held["frame_i"].astype("int64"), "j": held["frame_j"].astype("int64"), "confidence": held["confidence"].astype(float) if "confidence" in held else np.full(n, np.nan), "etype": held["edge_type"].astype(str) if "edge_type" in held else ""})

    return _files(spark, path, "*.npz", True).select("path", "content").mapInPandas(run, "path string, i long, j long, confidence double, etype string")


def edge_json(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """The same rows of JSON files that hold an array of edges, the older form."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.explode(F.from_json("value", "array<struct<frame_i:bigint,frame_j:bigint,confidence:double,edge_type:string>>")).alias("e"))
    return rows.select("path", F.col("e.frame_i").alias("i"), F.col("e.frame_j").alias("j"), "e.confidence", F.coalesce("e.edge_type", F.lit("")).alias("etype")).filter("i is not null and j is not null")


def point_cloud(spark: SparkSession, path: str, prefer_debug: bool = False) -> DataFrame:
    """(run, k, x, y, z) of the point file of each run folder: the full one or the usual
    one first, then any other by time, newest first."""
    order = ("pointcloud_full_debug.npz", "pointcloud.npz") if prefer_debug else ("pointcloud.npz", "pointcloud_full_debug.npz")
    files = _files(spark, path, "*.npz", True).select("path", "modificationTime", F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("run"))
    place = F.when(F.col("name") == order[0], 0).when(F.col("name") == order[1], 1).otherwise(2)
    best = files.groupBy("run").agg(F.min_by("path", F.struct(place, -F.unix_micros("modificationTime"), "name")).alias("path"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["run"], batch["content"], strict=True):
                held = _opened(content)
                if held is not None and "points" in held and held["points"].ndim == 2:
                    p = held["points"][:, :3].astype(float)
                    yield pd.DataFrame({"run": name, "k": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    chosen = _files(spark, path, "*.npz", True).select("path", "content").join(F.broadcast(best), "path")
    return chosen.select("run", "content").mapInPandas(run, "run string, k long, x double, y double, z double")


def text_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, x, y, t) of text files: numbers apart by space, comma or semicolon; lines without two are dropped."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.split(F.trim("value"), r"[\s,;]+").alias("v"))
    at = lambda k: number(F.try_element_at("v", F.lit(k)))
    return rows.select("path", "line", at(1).alias("x"), at(2).alias("y"), at(3).alias("t")).filter("x is not null and y is not null")


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(path, k, x, y) of JSON files with an array of points, which must hold two good ones."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_path").alias("path"), json_points(F.coalesce(F.get_json_object("value", "$.points"), "value")).alias("p"))
    short = F.concat(F.lit("fewer than two points in "), "path")
    checked = rows.select("path", F.when(F.size("p") >= 2, F.col("p")).otherwise(F.raise_error(short)).alias("p"))
    return checked.select("path", F.posexplode("p").alias("k", "e")).select("path", "k", "e.x", "e.y")


def route_lines(spark: SparkSession, path: str, key: str = "run") -> DataFrame:
    """(run, k, x, y) of JSON lines with a run and its points as document; a run needs two good ones."""
    rows = spark.read.text(path).select(F.get_json_object("value", f"$.{key}").cast("long").alias(key), json_points(F.get_json_object("value", "$.document")).alias("p"))
    short = F.concat(F.lit("fewer than two points in run "), F.col(key).cast("string"))
    checked = rows.select(key, F.when(F.size("p") >= 2, F.col("p")).otherwise(F.raise_error(short)).alias("p"))
    return checked.select(key, F.posexplode("p").alias("k", "e")).select(key, "k", "e.x", "e.y")


def analyses(spark: SparkSession, path: str, pattern: str = "*_analysis.json", lines: bool = False) -> DataFrame:
    """(video_id, uploaded_at, value, path) of the files *_analysis.json, newest first; with `lines`, a document a line.

    Copies from before a change (.pre-, .before_) and files without a video_id
    are left out; a missing time of upload is that of the file.
    """
    raw = spark.read.text(path, wholetext=not lines, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    rows = raw.filter(~F.col("path").rlike(r"(\.pre-|\.before_)")).withColumn("video_id", F.get_json_object("value", "$.video_id")).filter("trim(video_id) <> ''")
    return rows.select("video_id", F.coalesce(F.try_to_timestamp(F.get_json_object("value", "$.uploaded_at")), "changed").alias("uploaded_at"), "value", "path").orderBy(F.desc("uploaded_at"), "video_id")


def analysis_of(spark: SparkSession, path: str, video: str) -> DataFrame:
    """The analyses of one video; Spark prunes nothing here, the folder is the index."""
    return analyses(spark, path).filter(F.col("video_id") == video)


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, path, length, changed) of files named by an identifier of 36 signs and _; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("changed"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return files.filter(F.col("name").rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}_")).select(F.substring("name", 1, 36).alias("video_id"), "path", "length", "changed")


def volumes(spark: SparkSession, path: str) -> DataFrame:
    """(volume, files, bytes, fingerprint) of media below a folder, by its first folder; a fingerprint covers path, size and time."""
    files = _files(spark, path, "*.{" + ",".join([*MEDIA, *[m.upper() for m in MEDIA]]) + "}", True).select("path", "length", "modificationTime").dropDuplicates(["path"])
    rest = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    root = path.split(":", 1)[-1].rstrip("/")
    inner = F.split(F.ltrim(F.substr(rest, F.lit(len("/" + root.lstrip("/")) + 1)), F.lit("/")), "/")
    mark = F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256)
    return files.filter(F.size(inner) <= 7).groupBy(inner[0].alias("volume")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.sort_array(F.collect_list(mark)), ","), 256).alias("fingerprint"))


def session_state(spark: SparkSession, path: str, sessions: DataFrame, default: dict[str, str]) -> DataFrame:
    """sessions (session) with the state of their JSON file, the defaults where a file or a key is missing."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("session"), json_or_empty(F.col("value")).alias("state"))
    return sessions.join(raw, "session", "left").select("session", *[F.coalesce(F.try_element_at("state", F.lit(k)), F.lit(v)).alias(k) for k, v in default.items()])


def session_lines(spark: SparkSession, path: str, sessions: DataFrame, key: str, default: dict[str, str]) -> DataFrame:
    """sessions (key) with their state from JSON lines, the defaults where a line or a name in it is missing."""
    raw = spark.read.text(path).select(F.get_json_object("value", f"$.{key}").cast("long").alias(key), json_or_empty(F.get_json_object("value", "$.document")).alias("state"))
    return sessions.join(raw, key, "left").select(key, *[F.coalesce(F.try_element_at("state", F.lit(k)), F.lit(v)).alias(k) for k, v in default.items()])


def chosen_candidates(candidates: DataFrame, summaries: DataFrame, expected: DataFrame, order: list[str], accepted_only: bool = True) -> DataFrame:
    """Which candidate each run takes: (run, candidate, and the state of each one in order).

    candidates (candidate, run, frame) hold a row a frame, summaries (candidate,
    run, accepted), expected (run, n). A candidate is `missing` without frames,
    `not_accepted` without an accepting summary, `frame_count` with another
    number of frames, else `ok`; the first that is ok is taken, else `raw`.
    """
    counts = candidates.groupBy("candidate", "run").agg(F.count_distinct("frame").alias("frames"))
    said = summaries.groupBy("candidate", "run").agg(F.bool_and(F.coalesce("accepted", F.lit(False))).alias("accepted"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("candidate")) for k, n in enumerate(order)]))
    rows = expected.select("run", "n", names.alias("c")).select("run", "n", "c.*").join(counts, ["candidate", "run"], "left").join(said, ["candidate", "run"], "left")
    refused = ~F.coalesce("accepted", F.lit(False)) if accepted_only else F.lit(False)
    state = F.when(F.col("frames").isNull(), "missing").when(refused, "not_accepted").when(F.col("frames") != F.col("n"), "frame_count").otherwise("ok")
    rows = rows.withColumn("state", state)
    pick = F.coalesce(F.min(F.when(F.col("state") == "ok", F.struct("place", "candidate")))["candidate"], F.lit("raw"))
    return rows.groupBy("run").agg(pick.alias("candidate"), *[F.max(F.when(F.col("candidate") == n, F.col("state"))).alias(n) for n in order])
