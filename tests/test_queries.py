"""Every registered movement query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom.plans import registry

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted("|".join(map(canon, r)) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True))


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return out


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    assert rows(registry.QUERIES[name](spark, SF).toArrow()) == rows(con.sql(registry.ORACLES[name]).to_arrow_table())


#: Queries that carry decisions from row to row; tests/test_kernels.py holds their operators against plain versions.
BEYOND_SQL = {
    "floor_from_turns", "odometry_steps", "traj_camera_turns",
    "box_suppression", "detection_tracks", "floor_planes", "isotonic_calibration", "isotonic_scores", "motion_plane", "plan_loops_closed", "plan_matched", "plan_matched_second_order", "plan_regions", "plan_rerouted",
    "plan_routes", "plan_snapped", "pose_graph_long_runs", "pose_graph_optimised", "robust_similarity", "rotation_projection", "traj_adaptive_heading", "traj_chord_turns", "traj_cleaned", "traj_clipped_smooth",
    "traj_curvature_anchors", "traj_hysteresis_turns", "traj_kalman", "traj_map_turns", "traj_motion_states", "traj_scale_curve", "traj_scale_regimes", "traj_simplified", "traj_stabilised",
    "traj_straightened", "traj_trend_window", "turn_topology", "two_source_fusion",
}


def test_every_other_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == BEYOND_SQL


@pytest.mark.parametrize("name", sorted(BEYOND_SQL))
def test_queries_beyond_sql_run(spark, name):
    table = registry.QUERIES[name](spark, SF).toArrow()
    assert table.num_rows > 0 and len(set(table.column_names)) == table.num_columns


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
