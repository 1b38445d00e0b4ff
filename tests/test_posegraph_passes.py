"""What a pose graph's passes move: rounds only for runs that need them, blocks together in a call."""

import numpy as np

from pathloom.operators import posegraph
from test_posegraph import drifting, edges_of, rmse, run_of, winding


def stored_by(monkeypatch):
    names, write = [], posegraph.stored
    monkeypatch.setattr(posegraph, "stored", lambda df, name: names.append(name) or write(df, name))
    return names


def test_a_run_whose_edges_agree_takes_no_round(spark, monkeypatch):
    route = winding(90, 3)
    names = stored_by(monkeypatch)
    got, seen = run_of(spark, {1: drifting(route)}, {1: edges_of(route)}, 16)
    assert seen[1][0] and rmse(got[1], route) < 1e-6
    assert len(names) < 10, names


def test_runs_with_and_without_rounds_stand_side_by_side(spark, monkeypatch):
    monkeypatch.setattr(posegraph, "FRAMES_A_CALL", 50)
    routes = {1: winding(60, 3), 2: winding(60, 4), 3: winding(12, 5)}
    starts = {r: drifting(route) for r, route in routes.items()}
    names = stored_by(monkeypatch)
    got, seen = run_of(spark, starts, {1: edges_of(routes[1]), 2: edges_of(routes[2], noise=0.01), 3: edges_of(routes[3])}, 16)
    assert names.count("states") == 2 * posegraph.ROUNDS
    for r, most in ((1, 1e-6), (2, rmse(starts[2], routes[2]) / 2), (3, 1e-6)):
        assert seen[r][0] and len(got[r]) == len(routes[r]) and rmse(got[r], routes[r]) < most
    alone, _ = run_of(spark, {2: starts[2]}, {2: edges_of(routes[2], noise=0.01)}, 16)
    assert np.abs(alone[2] - got[2]).max() < 1e-9


def test_relative_poses_across_stretches_and_missing_frames(spark, monkeypatch):
    monkeypatch.setattr(posegraph, "STRETCH", 7)
    route, frames = winding(40, 6), [k - 9 for k in range(40) if k not in (3, 8, 20, 21)]
    rows = spark.createDataFrame([(r, k, route[k + 9].reshape(-1).tolist()) for r in (1, 2) for k in frames], "run long, frame long, pose array<double>")
    got = {(e["run"], e["i"], e["j"]): e for e in posegraph.relative(rows, (1, 2, 5)).collect()}
    assert set(got) == {(r, k, k + g) for r in (1, 2) for k in frames for g in (1, 2, 5) if k + g in frames}
    for (_, i, j), e in got.items():
        a, b = route[i + 9], route[j + 9]
        assert np.abs(np.array(e["rotation"]).reshape(3, 3) - b[:3, :3].T @ a[:3, :3]).max() < 1e-12
        assert np.abs(np.array(e["shift"]) - b[:3, :3].T @ (a[:3, 3] - b[:3, 3])).max() < 1e-12
