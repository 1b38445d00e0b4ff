"""Readers, sinks and streams over folders with odd files."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.sources import readers, sinks
from pathloom.sources.shared import shared_dir
from pathloom.streaming import events


def test_damaged_and_foreign_files_are_skipped(spark, tmp_path):
    run = tmp_path / "r1"
    run.mkdir()
    np.savez(run / "000003.npz", pose=np.eye(4))
    np.savez(run / "000004.npz", pose=np.full((4, 4), np.nan))
    np.savez(run / "other.npz", x=np.zeros(3))
    (run / "000005.npz").write_bytes(b"PK half a file")
    world = np.eye(4)
    world[:3, 3] = 1, 2, 3
    np.savez(run / "stack.npz", cam_T_world=np.stack([world[:3], np.eye(4)[:3]]))
    got = {(r["frame"], r["source"]): (r["pose"][3], r["pose"][7], r["pose"][11]) for r in readers.poses(spark, str(tmp_path)).collect()}
    assert got == {(3, "pose"): (0, 0, 0), (0, "cam_T_world"): (-1, -2, -3), (1, "cam_T_world"): (0, 0, 0)}


def test_edge_files_keep_their_contract(spark, tmp_path):
    held = {"frame_i": np.array([0, 1]), "frame_j": np.array([1, 2]), "confidence": np.array([1.0, 2.0])}
    np.savez(tmp_path / "a.npz", **held, **readers.EDGE_CONTRACT)
    assert readers.edge_lists(spark, str(tmp_path), strict=True).count() == 2
    np.savez(tmp_path / "b.npz", **held)
    assert readers.edge_lists(spark, str(tmp_path)).count() == 4
    with pytest.raises(Exception, match="differ from the contract"):
        readers.edge_lists(spark, str(tmp_path), strict=True).count()


def test_point_files_by_precedence(spark, tmp_path):
    for run, names in {"a": ["pointcloud_full_debug", "pointcloud", "x"], "b": ["pointcloud_full_debug", "x"], "c": ["x"]}.items():
        (tmp_path / run).mkdir()
        for name in names:
            np.savez(tmp_path / run / f"{name}.npz", points=np.full((2, 3), float(len(name))))
    usual = {r["run"]: r["x"] for r in readers.point_cloud(spark, str(tmp_path)).filter("k = 0").collect()}
    debug = {r["run"]: r["x"] for r in readers.point_cloud(spark, str(tmp_path), True).filter("k = 0").collect()}
    assert usual == {"a": 10, "b": 21, "c": 1} and debug == {"a": 21, "b": 21, "c": 1}


def test_routes_need_two_points(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"points": [[0, 1], {"x": 2, "y": 3}, "no", [None, 1]]}))
    assert [(r["k"], r["x"], r["y"]) for r in readers.routes(spark, str(tmp_path)).orderBy("k").collect()] == [(0, 0, 1), (1, 2, 3)]
    (tmp_path / "b.json").write_text("[[1, 1]]")
    with pytest.raises(Exception, match="fewer than two points"):
        readers.routes(spark, str(tmp_path)).count()


def test_analyses_without_copies(spark, tmp_path):
    for name, text in {"a_analysis.json": '{"video_id": "v1", "uploaded_at": "2024-05-01 00:00:00"}', "b_analysis.pre-1.json": '{"video_id": "v2"}', "c_analysis.json": '{"video_id": "  "}', "d_analysis.json": '{"video_id": "v3", "uploaded_at": "2023-01-01 00:00:00"}', "e.before_x_analysis.json": '{"video_id": "v4"}'}.items():
        (tmp_path / name).write_text(text)
    assert [r["video_id"] for r in readers.analyses(spark, str(tmp_path)).collect()] == ["v1", "v3"]
    assert readers.analysis_of(spark, str(tmp_path), "v3").count() == 1 and readers.analysis_of(spark, str(tmp_path), "none").count() == 0


def test_candidates_never_overwrite_raw_data(spark, tmp_path):
    df = spark.range(3)
    for name in ("", "raw", "a/b"):
        with pytest.raises(ValueError, match="candidate"):
            sinks.write_candidate(df, str(tmp_path), name)
    assert spark.read.parquet(sinks.write_candidate(df, str(tmp_path), "x")).count() == 3


def test_session_defaults(spark, tmp_path):
    (tmp_path / "s1.json").write_text('{"state": "done"}')
    (tmp_path / "s2.json").write_text("{bad")
    got = readers.session_state(spark, str(tmp_path), spark.createDataFrame([("s1",), ("s2",), ("s3",)], "session string"), {"state": "idle", "fps": "0"})
    assert sorted(map(tuple, got.collect())) == [("s1", "done", "0"), ("s2", "idle", "0"), ("s3", "idle", "0")]


def test_a_stream_goes_on_with_new_files_only(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    seen = []
    for k in range(2):
        spark.range(3).select(F.lit(k).cast("long").alias("run"), "id").coalesce(1).write.mode("append").json(str(source))
        query = events.tail(spark, str(source), "run long, id long").writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert seen == [3, 3]


def test_reset_starts_a_state_anew(spark, tmp_path):
    rows = [("a", 0.0, "x"), ("a", 5.0, "y"), ("a", 7.0, "reset"), ("a", 9.0, "x"), ("a", 10.0, "z"), ("b", 1.0, "x"), ("b", 1.0, "x"), ("b", 4.0, "y")]
    spark.createDataFrame(rows, "run string, t double, stage string").coalesce(1).write.json(str(tmp_path / "in"))
    got = events.replayed(events.stage_seconds(events.tail(spark, str(tmp_path / "in"), "run string, t double, stage string")), "reset-test", "update", latest=["run", "stage"])
    assert {(r["run"], r["stage"]): r["seconds"] for r in got.collect()} == {("a", "x"): 1.0, ("b", "x"): 3.0}


def test_runs_that_are_over_leave_no_state(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def write(k, rows):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"run": r, "t": f"2024-01-01T00:{m:02d}:00", "stage": s}) for r, m, s in rows))
        os.utime(source / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)  # the source takes files by their time

    def run():
        stream = events.stage_seconds_until(events.tail(spark, str(source), "run string, t timestamp, stage string", files=1), "5 minutes", "2 minutes")
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return events.held_rows(q)

    write(1, [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "x")])
    write(2, [("a", 2, "y"), ("a", 4, "z"), ("b", 3, "y")])  # one row comes late, but in time
    write(3, [("c", 30, "x"), ("c", 31, "y")])
    write(4, [("c", 5, "late"), ("d", 59, "x")])
    assert run() == 1  # a, b and c are over, d goes on
    rows = lambda: sorted((r["run"], r["stage"] or "", 0.0 if r["stage"] is None else r["seconds"], r["visits"]) for r in spark.read.parquet(str(out)).collect())
    assert rows() == [("a", "x", 60.0, 1), ("a", "y", 120.0, 1), ("b", "x", 60.0, 1), ("c", "", 0.0, 1), ("c", "x", 60.0, 1)]
    before = rows()
    run()  # a restart repeats nothing
    assert rows() == before


def test_a_cluster_needs_a_shared_folder(monkeypatch, spark):
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Fake())
