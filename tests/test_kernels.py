"""Sequential kernels, alignment, routing and pose graphs against plain versions and fixtures."""

import collections
import heapq
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import alignment, calibration, joins, kernels, posegraph, ranking, repair, routing, series


def runs(spark, paths, extra=()):
    """paths: {run: rows of (t, x, y, *extra)}."""
    rows = [(r, float(p[0]), k, *[None if v is None else float(v) for v in p[1:]]) for r, path in paths.items() for k, p in enumerate(path)]
    return spark.createDataFrame(rows, ", ".join(["run long", "t double", "id long", "x double", "y double", *[f"{e} double" for e in extra]]))


def by_run(df, *names):
    out = collections.defaultdict(list)
    for r in df.orderBy("run", "id").collect():
        out[r["run"]].append(tuple(r[n] for n in names))
    return out


# -- repair


def plain_cleaned(points, conf):
    p = np.array(points, float)
    n, good = len(p), np.isfinite(p).all(axis=1)
    at = np.arange(n)
    for c in (0, 1):
        p[:, c] = np.interp(at, at[good], p[good, c])
    step = np.hypot(*np.diff(p, axis=0).T)
    pos = step[step > 1e-8]
    med, p75 = np.median(pos), np.percentile(pos, 75)
    sure = conf[np.isfinite(conf)]
    low = np.percentile(sure, 12) if len(sure) >= 5 else -math.inf
    weak = [not math.isfinite(c) or c <= low for c in conf]
    bad = ~good
    for i in range(1, n - 1):
        a, b = p[i] - p[i - 1], p[i + 1] - p[i]
        na, nb = np.hypot(*a), np.hypot(*b)
        if max(na, nb) > max(5 * med, 2.5 * p75, 1e-6):
            bad[i] = True
        elif na > 1e-8 and nb > 1e-8 and a @ b / (na * nb) < -0.75 and i + 2 < n:
            r = p[i + 2] - p[i + 1]
            nr = np.hypot(*r)
            bad[i] |= bool(nr > 1e-8 and b @ r / (nb * nr) > 0.55 and max(na, nb) > max(2.5 * med, 1.5 * p75, 1e-6) and weak[i])
    for r in range(2, min(6, max(2, n // 150)) + 1):
        for i in range(r, n - r):
            chord = p[i + r] - p[i - r]
            if chord @ chord > 1e-12:
                share = np.clip((p[i] - p[i - r]) @ chord / (chord @ chord), 0, 1)
                far = np.hypot(*(p[i] - p[i - r] - share * chord))
                length = step[i - r : i + r].sum()
                if far > max(4 * med, 2.2 * p75, 1e-6) and length > max(1.8 * np.hypot(*chord), 2.5 * med * r) and weak[i]:
                    bad[i] = True
    if not bad.all():
        for c in (0, 1):
            p[:, c] = np.interp(at, at[~bad], p[~bad, c])
    out = p.copy()
    for i in range(1, n - 1):
        a, b = p[i] - p[i - 1], p[i + 1] - p[i]
        if np.hypot(*a) > 1e-8 and np.hypot(*b) > 1e-8 and a @ b > math.cos(math.radians(20)) * np.hypot(*a) * np.hypot(*b):
            out[i] = (p[i - 1] + 2 * p[i] + p[i + 1]) / 4
    return out, bad


def test_cleaning_equals_a_plain_one(spark):
    rng = np.random.default_rng(1)
    paths = {}
    for r, n in enumerate((12, 80, 700)):
        p = np.cumsum(rng.normal([1, 0], 0.3, (n, 2)), axis=0)
        for k in rng.integers(1, n - 2, max(2, n // 20)):
            p[k] += rng.normal(0, 12, 2)
            p[k : k + 3] += rng.normal(0, 4, 2)
        p[n // 2] = np.nan
        paths[r] = [(k, *q, c) for k, (q, c) in enumerate(zip(p.tolist(), rng.uniform(0, 1, n).tolist(), strict=True))]
    got = by_run(repair.cleaned(runs(spark, paths, ["conf"]), "conf"), "x", "y", "outlier")
    for r, path in paths.items():
        want, bad = plain_cleaned([q[1:3] for q in path], np.array([q[3] for q in path]))
        assert [v[2] for v in got[r]] == bad.tolist()
        assert np.allclose([v[:2] for v in got[r]], want, atol=1e-9)


def test_jitter_is_smoothed_only_where_it_is_safe(spark):
    rng = np.random.default_rng(2)
    line = np.stack([np.arange(200) * 0.1, np.zeros(200)], axis=1) + rng.normal(0, 0.01, (200, 2))
    corner = np.array([(k, 1000 if k == 60 else 0) for k in range(120)], float)
    short = line[:50]
    paths = {k: [(i, *q) for i, q in enumerate(p.tolist())] for k, p in enumerate((line, corner, short))}
    got = by_run(repair.stabilised(runs(spark, paths)), "x", "y", "stable")
    assert [got[k][0][2] for k in range(3)] == [True, False, False]
    pad = lambda v, h: np.pad(v, h, mode="edge")
    for c in (0, 1):
        med = np.array([np.median(pad(line[:, c], 2)[i : i + 5]) for i in range(200)])
        mean = np.array([pad(med, 4)[i : i + 9].mean() for i in range(200)])
        mean[[0, -1]] = line[[0, -1], c]
        assert np.allclose([v[c] for v in got[0]], mean)
    assert np.allclose([v[:2] for v in got[1]], corner) and np.allclose([v[:2] for v in got[2]], short)


def test_clip_and_mean_keep_the_first_row(spark):
    rng = np.random.default_rng(3)
    p = np.cumsum(rng.normal(1, 0.2, (60, 2)), axis=0)
    p[30:] += 50
    got = np.array(by_run(repair.clipped_and_smoothed(runs(spark, {1: [(k, *q) for k, q in enumerate(p.tolist())]})), "x", "y")[1])
    step = np.diff(p, axis=0)
    size = np.hypot(*step.T)
    limit = max(3 * np.median(size), 2 * np.percentile(size, 75))
    q = np.concatenate([p[:1], p[0] + np.cumsum(step * np.minimum(1, limit / size)[:, None], axis=0)])
    padded = np.pad(q, ((15, 15), (0, 0)), mode="edge")
    mean = np.array([padded[i : i + 31].mean(axis=0) for i in range(60)])
    assert np.allclose(got, mean - mean[0] + p[0])


def test_widest_window_that_keeps_the_length(spark):
    line = [(k, k, 0) for k in range(30)]
    zigzag = [(k, k * 0.01, k % 2) for k in range(30)]
    got = by_run(repair.trend_window(runs(spark, {1: line, 2: zigzag})), "window")
    assert got[1][0] == (9,) and got[2][0] == (1,)


def test_adaptive_headings(spark):
    n = 300
    p = [(math.cos(k / 20) * 20, math.sin(k / 20) * 20) for k in range(n)]
    p[100:120] = [p[100]] * 20
    got = [v[0] for v in by_run(series.adaptive_heading(runs(spark, {1: [(k, *q) for k, q in enumerate(p)]})), "heading")[1]]
    h, want = 3, []
    for k in range(n):
        a, b = p[max(0, k - h)], p[min(n - 1, k + h)]
        want.append(math.atan2(b[1] - a[1], b[0] - a[0]) if math.dist(a, b) > 1e-7 else math.nan)
    ok = np.isfinite(want)
    want = np.degrees(np.interp(np.arange(n), np.flatnonzero(ok), np.unwrap(np.array(want)[ok])))
    assert np.allclose(got, want) and not ok.all()


# -- folds over rows


def test_kalman_equals_four_states(spark):
    rng = np.random.default_rng(4)
    t = np.cumsum(rng.uniform(0, 2, 200))
    z = np.cumsum(rng.normal(0, 1, (200, 2)), axis=0)
    got = np.array(by_run(kernels.kalman(runs(spark, {5: [(a, *q) for a, q in zip(t.tolist(), z.tolist(), strict=True)], 6: [(0, 1, 2)]})), "x", "y", "vx", "vy")[5])
    state, P, H = np.array([*z[0], 0, 0]), np.eye(4) * 1000, np.eye(2, 4)
    assert np.allclose(got[0], state)
    for k in range(1, 200):
        dt = max(1e-3, t[k] - t[k - 1])
        A = np.eye(4)
        A[0, 2] = A[1, 3] = dt
        state, P = A @ state, A @ P @ A.T + np.eye(4) * 0.05 * max(1, dt)
        K = P @ H.T @ np.linalg.inv(H @ P @ H.T + np.eye(2))
        state, P = state + K @ (z[k] - H @ state), (np.eye(4) - K @ H) @ P
        assert np.allclose(got[k], state)


def test_turn_sessions_start_and_end_by_two_thresholds(spark):
    change = [0.0] * 10 + [9.0] * 10 + [0.0] * 10 + [-1.0] * 8 + [0.0] * 10 + [-12.0] * 4 + [0.0] * 10
    rows = runs(spark, {1: [(k, 0, 0, c, 1) for k, c in enumerate(change)], 2: [(k, 0, 0, 0, 1) for k in range(20)]}, ["change", "speed"])
    got = kernels.hysteresis_turns(rows, "change", "speed").orderBy("middle").collect()
    assert [(r["run"], r["angle"], r["kind"]) for r in got] == [(1, 90.0, "left"), (1, -48.0, "right")]


def test_states_need_several_rows(spark):
    rows = [(1, float(k), k, m, turn, 0.0, 0.01, True) for k, (m, turn) in enumerate([(1.0, 0.0)] * 3 + [(0.0, 0.0)] * 6 + [(1.0, 0.0)] * 8)] + [(2, float(k), k, 0.0, 5.0, 9.0, 0.9, True) for k in range(3)]
    got = kernels.motion_states(spark.createDataFrame(rows, "run long, t double, id long, move double, turn double, flow double, conf double, posed boolean")).orderBy("run", "id").collect()
    names = [r["state"] for r in got]
    assert names[:17] == ["moving"] * 6 + ["stationary"] * 8 + ["moving"] * 3 and names[17:] == ["moving", "turn_in_place", "turn_in_place"]


def test_tracks_follow_boxes(spark):
    rows = [(1, float(t), 10 * t + k, x, y, x + 4, y + 4) for t in range(6) for k, (x, y) in enumerate([(t * 1.0, 0.0), (30.0 - t, 30.0)])] + [(1, 20.0, 900, 5.0, 0.0, 9.0, 4.0)]
    got = {r["id"]: r["track"] for r in kernels.tracked(spark.createDataFrame(rows, "run long, t double, id long, x1 double, y1 double, x2 double, y2 double")).collect()}
    assert {got[10 * t] for t in range(6)} == {1} and {got[10 * t + 1] for t in range(6)} == {2} and got[900] == 1


def test_suppression_equals_a_plain_one(spark):
    rng = random.Random(5)
    rows = [(f, k, rng.random(), x := rng.uniform(0, 10), y := rng.uniform(0, 10), x + 3, y + 3) for f in range(3) for k in range(40)]
    got = {(r["frame"], r["id"]) for r in kernels.suppressed(spark.createDataFrame(rows, "frame long, id long, score double, x1 double, y1 double, x2 double, y2 double"), 0.3).collect()}
    want = set()
    for f in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == f), key=lambda r: -r[2]):
            met = lambda q: max(0, min(r[5], q[5]) - max(r[3], q[3])) * max(0, min(r[6], q[6]) - max(r[4], q[4]))  # noqa: B023, E731
            if all(met(q) / (18 - met(q) + 1e-6) <= 0.3 for q in kept):
                kept.append(r)
        want |= {(f, r[1]) for r in kept}
    assert got == want


def test_simplified_paths_stay_near(spark):
    rng = np.random.default_rng(6)
    p = np.cumsum(rng.normal(0, 1, (300, 2)), axis=0)
    got = sorted((r["k"], r["x"], r["y"]) for r in kernels.simplified(runs(spark, {1: [(k, *q) for k, q in enumerate(p.tolist())], 2: [(0, 1, 1)]}), 3.0).filter("run = 1").collect())

    def plain(a, b):
        chord = p[b] - p[a]
        share = np.clip((p[a : b + 1] - p[a]) @ chord / max(chord @ chord, 1e-300), 0, 1)
        off = np.hypot(*(p[a : b + 1] - p[a] - share[:, None] * chord).T)
        k = a + int(off.argmax())
        return plain(a, k)[:-1] + plain(k, b) if off.max() >= 3.0 else [a, b]

    assert [g[0] for g in got] == plain(0, 299)


def test_map_turns_of_a_staircase(spark):
    path = [(k, 0) for k in range(20)] + [(20, k) for k in range(20)] + [(20 - k, 20) for k in range(20)]
    got = kernels.map_turns(runs(spark, {1: [(k, *q) for k, q in enumerate(path)]}), 2.0).orderBy("k").collect()
    assert [(r["kind"], r["angle"]) for r in got] == [("left", 90.0), ("left", 90.0)]


def test_isotonic_equals_block_means(spark):
    rng = random.Random(7)
    rows = [("a", rng.random(), rng.randint(0, 1)) for _ in range(60)] + [("b", rng.random(), 1) for _ in range(30)] + [("a", None, 1), ("a", 0.5, 7)]
    got = [(r["probability"], r["n"]) for r in calibration.isotonic(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").orderBy("step").collect()]
    y = [float(v) for _, _, v in sorted(((g, s, v) for g, s, v in rows if g == "a" and s is not None and v < 2), key=lambda r: (r[1], r[2]))]
    # The least-squares monotone fit: max over starts of the min over ends of the means.
    n = len(y)
    fit = [max(min(sum(y[a : b + 1]) / (b - a + 1) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]
    assert np.allclose([p for p, c in got for _ in range(c)], fit)
    assert all(p < q for (p, _), (q, _) in itertools.pairwise(got))


def test_scale_reset_is_taken_out(spark):
    x = np.cumsum([0] + [1] * 60 + [3] * 80)
    again = np.cumsum([0] + [1] * 50 + [0.4] * 160)
    paths = {1: [(k, v, 0) for k, v in enumerate(x)], 2: [(k, v, 0) for k, v in enumerate(again)], 3: [(k, v, 0) for k, v in enumerate(x)]}
    cuts = spark.createDataFrame([(1, 61), (2, 51), (2, 91), (2, 131), (2, 171)], "run long, k long")
    got = by_run(kernels.regimes(runs(spark, paths), cuts), "x", "factor")
    assert abs(got[1][-1][0] - 142) <= 3 and abs(got[1][-1][1] - 1 / 3) < 0.05 / 3
    assert abs(got[2][-1][0] - 208) <= 4 and {round(f, 6) for _, f in got[2]} == {1.0, 2.5}
    assert [v[0] for v in got[3]] == x.tolist()


def test_same_speed_is_no_new_regime(spark):
    t = np.concatenate([np.arange(61) * 0.2, 12 + np.arange(1, 81) * 0.6])
    x = np.concatenate([np.arange(61) * 1.0, 60 + np.arange(1, 81) * 3.0])
    got = by_run(kernels.regimes(runs(spark, {1: [(a, b, 0) for a, b in zip(t, x, strict=True)]}), spark.createDataFrame([(1, 61)], "run long, k long")), "x", "factor")
    assert {f for _, f in got[1]} == {1.0}


def test_drift_goes_and_corners_stay(spark):
    rng = np.random.default_rng(8)
    straight = [(k, k, 0.3 * math.sin(k / 4)) for k in range(60)]
    corner = [(k, 59, k - 60) for k in range(61, 110)]
    turns = spark.createDataFrame([(1, 58, 62), (2, 200, 300)], "run long, first long, last long")
    wild = [(k, *rng.normal(0, 5, 2)) for k in range(40)]
    got = by_run(kernels.straightened(runs(spark, {1: straight + corner, 2: wild}), turns), "x", "y", "straight")
    flags = [v[2] for v in got[1]]
    assert all(flags[:50]) and np.abs([v[1] for v in got[1][10:48]]).max() < 0.12 and not any(v[2] for v in got[2])
    assert got[1][0][:2] == (0.0, 0.0) and np.allclose(got[1][-1][:2], corner[-1][1:])


def test_anchors_keep_ends_and_bends(spark):
    path = [(k, k, 0) for k in range(50)] + [(k, 49, k - 49) for k in range(50, 100)]
    got = sorted(r["k"] for r in kernels.anchors(runs(spark, {1: path, 2: [(0, 0, 0), (1, 1, 1)]}), 30.0, 9).filter("run = 1").collect())
    assert got[0] == 0 and got[-1] == 99 and 49 in got and len(got) <= 9


def test_banded_solution_equals_the_dense_one():
    rng = np.random.default_rng(9)
    for n in (1, 2, 3, 4, 60):
        at = np.unique(rng.integers(0, n, 8))
        y, w = rng.normal(0, 1, len(at)), rng.uniform(0.1, 2, len(at))
        A = np.eye(n) * 1e-6
        A[at, at] += w
        if n >= 3:
            D = np.zeros((n - 2, n))
            for k in range(n - 2):
                D[k, k : k + 3] = 1, -2, 1
            A += 80 * D.T @ D
        b = np.zeros(n)
        b[at] = w * y
        assert np.allclose(kernels.smooth_curve(n, at, y, w), np.linalg.solve(A, b), atol=1e-6)


def test_heights_scale_the_steps(spark):
    path = [(k, k if k < 60 else 60 + 2 * (k - 60), 0, (1.0 if k < 60 else 2.0) if k % 2 else None, 5) for k in range(120)]
    got = by_run(kernels.scale_curve(runs(spark, {1: path}, ["h", "w"]), "h", "w"), "x", "scale")[1]
    step = np.diff([v[0] for v in got])
    assert abs(np.median(step[80:]) / np.median(step[:40]) - 1) < 0.08


def test_events_match_in_order(spark):
    events = spark.createDataFrame([(1, 1, 0.1, 90.0), (1, 2, 0.3, -90.0), (1, 3, 0.9, 45.0)], "run long, l long, at double, angle double")
    pairs = spark.createDataFrame([(1, 1, 10, 0.12, -90.0), (1, 1, 11, 0.2, 80.0), (1, 2, 10, 0.12, -90.0), (1, 2, 12, 0.33, -70.0)], "run long, l long, r long, r_at double, r_angle double")
    got = kernels.ordered_matches(pairs, events).orderBy("l").collect()
    assert [(r["l"], r["r"], round(r["error"], 6), r["mismatch"]) for r in got] == [(1, 11, 10.0, False), (2, 12, 20.0, False), (3, None, 45.0, True)]


# -- alignment


def test_rotations_are_the_nearest(spark):
    rng = np.random.default_rng(10)
    m = rng.normal(0, 1, (50, 3, 3))
    r = alignment.nearest_rotation(m)
    assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3)) and np.allclose(np.linalg.det(r), 1)
    for a, b in zip(m, r, strict=True):
        for _ in range(20):
            q = np.linalg.qr(rng.normal(0, 1, (3, 3)))[0]
            q *= np.sign(np.linalg.det(q))
            assert ((a - b) ** 2).sum() <= ((a - q) ** 2).sum() + 1e-9
    rows = spark.createDataFrame([(0, m[0].reshape(-1).tolist()), (1, None), (2, [1.0, float("nan")] + [0.0] * 7), (3, [1.0])], "id long, m array<double>")
    got = {x["id"]: x["r"] for x in rows.select("id", alignment.projected_rotation("m").alias("r")).collect()}
    assert np.allclose(got[0], r[0].reshape(-1)) and got[1] is None and got[2] is None and got[3] is None


def test_motion_plane_equals_principal_axes(spark):
    rng = np.random.default_rng(11)
    p = rng.normal(0, 1, (100, 3)) @ np.diag([5, 2, 0.1]) @ np.linalg.qr(rng.normal(0, 1, (3, 3)))[0] + 7
    got = sorted((r["id"], r["u"], r["v"], r["plane_share"]) for r in alignment.motion_plane(spark.createDataFrame([(1, k, *q) for k, q in enumerate(p.tolist())], "run long, id long, x double, y double, z double"), "run", ["id"]).collect())
    c = p - np.median(p, axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs([g[1:3] for g in got]), np.abs(c @ v.T), atol=1e-6) and got[0][3] > 0.99


def test_similarity_is_not_swayed_by_outliers(spark):
    rng = np.random.default_rng(12)
    p = rng.uniform(-10, 10, (200, 2))
    a = math.radians(31)
    q = 2.4 * p @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]]) + [13, -8]
    q[::12] += 60
    fit = alignment.robust_similarity(spark.createDataFrame([(1, *x, *y) for x, y in zip(p.tolist(), q.tolist(), strict=True)], "g long, x double, y double, u double, v double"), "g").first()
    plain = np.linalg.lstsq(np.concatenate([np.stack([p[:, 0], -p[:, 1], np.ones(200), np.zeros(200)], 1), np.stack([p[:, 1], p[:, 0], np.zeros(200), np.ones(200)], 1)]), np.concatenate([q[:, 0], q[:, 1]]), rcond=None)[0]
    off = abs(fit["dx"] - 13) + abs(fit["dy"] + 8)
    assert off < 0.5 * (abs(plain[2] - 13) + abs(plain[3] + 8)) and abs(fit["angle"] - 31) < 2 and abs(fit["scale"] - 2.4) < 0.1


def test_two_observers_are_fused_where_they_agree(spark):
    rng = np.random.default_rng(13)
    a = np.concatenate([[(k, 0) for k in range(8)], [(7, k) for k in range(1, 7)], [(7 + k, 6) for k in range(1, 7)]]).astype(float)
    turn = math.radians(31)
    b = 2.4 * a @ np.array([[math.cos(turn), math.sin(turn)], [-math.sin(turn), math.cos(turn)]]) + [13, -8]
    first = {1: [(k, *q) for k, q in enumerate(a.tolist())], 2: [(k, *q) for k, q in enumerate(a.tolist())]}
    second = {1: [(k, *q) for k, q in enumerate(b.tolist())], 2: [(k, *q) for k, q in enumerate(rng.normal(0, 5, a.shape).tolist())]}
    rows, gates = alignment.fused(runs(spark, first), runs(spark, second), "run", "t", "id")
    gate = {r["run"]: r for r in gates.collect()}
    assert gate[1]["accepted"] and gate[1]["p95_ratio"] < 0.02 and not gate[2]["accepted"]
    got = by_run(rows, "x", "y")
    assert np.allclose(got[1], a, atol=1e-6) and np.allclose(got[2], a)


def test_floor_is_found_among_other_points(spark):
    rng = np.random.default_rng(14)
    floor = np.stack([rng.uniform(-3, 3, 300), 1.6 + rng.normal(0, 0.002, 300), rng.uniform(1, 6, 300)], 1)
    noise = rng.uniform(-3, 3, (200, 3))
    rows = [(1, k, *q) for k, q in enumerate(np.concatenate([floor, noise]).tolist())] + [(2, k, *q) for k, q in enumerate(noise.tolist())] + [(3, k, *q) for k, q in enumerate(floor[:50].tolist())]
    got = {r["frame"]: r for r in alignment.floor_planes(spark.createDataFrame(rows, "frame long, id long, x double, y double, z double"), (0.0, 1.0, 0.0)).collect()}
    assert abs(got[1]["height"] - 1.6) < 0.02 and got[1]["alignment"] > 0.99 and 3 not in got


def test_pose_graph_straightens_a_drifting_route(spark):
    n = 60
    angle = np.array([0.0 if k < 30 else 1.2 * min(1, (k - 29) / 4) for k in range(n)])
    step = np.stack([np.sin(angle), np.zeros(n), np.cos(angle)], 1)
    centre = np.cumsum(step, axis=0)

    def pose(a, c):
        m = np.eye(4)
        m[:3, :3] = [[math.cos(a), 0, math.sin(a)], [0, 1, 0], [-math.sin(a), 0, math.cos(a)]]
        m[:3, 3] = c
        return m.reshape(-1).tolist()

    true = [(1, k, pose(angle[k], centre[k])) for k in range(n)]
    drift = [(1, k, pose(angle[k] + 0.01 * k, centre[k] * 1.2 + [0.004 * k * k, 0, 0] if k else centre[k])) for k in range(n)]
    kind = "run long, frame long, pose array<double>"
    edges = posegraph.relative(spark.createDataFrame(true, kind), (1, 2, 5)).withColumn("weight", F.lit(1.0))
    rng = random.Random(3)
    wrong = [(1, (i := rng.randrange(30)), i + 20, [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [rng.uniform(-9, 9) for _ in range(3)], 1.0) for _ in range(5)] + [(1, 5, 5, [1.0] * 9, [0.0] * 3, 1.0), (1, 5, 900, [1.0] * 9, [0.0] * 3, 1.0)]
    edges = edges.union(spark.createDataFrame(wrong, edges.schema))
    rows = posegraph.optimise(spark.createDataFrame(drift + [(2, 0, drift[0][2])], kind), edges).orderBy("run", "frame").collect()
    got = np.array([np.array(r["pose"]).reshape(4, 4)[:3, 3] for r in rows if r["run"] == 1])
    before = np.array([np.array(d[2]).reshape(4, 4)[:3, 3] for d in drift])
    rmse = lambda p: math.sqrt(((p - centre) ** 2).sum(axis=1).mean())
    assert rows[0]["accepted"] and rows[0]["gain"] > 0.3 and rmse(got) < 0.2 * rmse(before)
    assert [r["accepted"] for r in rows if r["run"] == 2] == [False]


# -- plans


def grid(seed, width=14, height=10, share=0.25):
    rng = random.Random(seed)
    return {(x, y): rng.random() < share for x in range(width) for y in range(height)}


def cells_of(spark, held, plan=1):
    return spark.createDataFrame([(plan, x, y, o) for (x, y), o in held.items()], "map long, cx long, cy long, occupied boolean")


def test_clearance_regions_and_routes_equal_plain_ones(spark):
    held = grid(1)
    cells = routing.clearance(cells_of(spark, held), 5)
    room = {(r["cx"], r["cy"]): r["clearance"] for r in cells.collect()}
    walls = [p for p, o in held.items() if o]
    assert room == {p: min(5.0, min(math.dist(p, w) for w in walls)) for p in held}
    fat = {(r["cx"], r["cy"]): r["occupied"] for r in routing.inflated(cells_of(spark, held), 1).collect()}
    assert fat == {p: min(math.dist(p, w) for w in walls) <= 1 for p in held}
    around = lambda p: [(p[0] + a, p[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and held.get((p[0] + a, p[1] + b)) is False]
    want = {}
    for p in sorted((p for p, o in held.items() if not o), key=lambda p: p[1] * 14 + p[0]):
        if p not in want:
            todo = [p]
            while todo:
                q = todo.pop()
                if q not in want:
                    want[q] = p[1] * 14 + p[0]
                    todo += around(q)
    assert {(r["cx"], r["cy"]): r["region"] for r in routing.regions(cells_of(spark, held), 14).collect()} == want

    def dijkstra(a, b):
        best, queue = {a: 0.0}, [(0.0, a)]
        while queue:
            c, p = heapq.heappop(queue)
            if p == b:
                return c
            for q in around(p):
                n = c + math.dist(p, q) * (1 + 0.25 / (room[q] + 0.5))
                if n < best.get(q, math.inf) - 1e-12:
                    best[q] = n
                    heapq.heappush(queue, (n, q))
        return None

    free = [p for p, o in held.items() if not o]
    rng = random.Random(2)
    asked = {k: (rng.choice(free), rng.choice(free)) for k in range(30)}
    got = collections.defaultdict(list)
    for r in routing.routes(spark.createDataFrame([(1, k, *a, *b) for k, (a, b) in asked.items()], "map long, id long, x0 long, y0 long, x1 long, y1 long"), cells, block=7).orderBy("id", "k").collect():
        got[r["id"]].append(r)
    for k, (a, b) in asked.items():
        cost = dijkstra(a, b)
        path = [(r["cx"], r["cy"]) for r in got[k]]
        assert (cost is None) == (not path)
        if path:
            assert path[0] == a and path[-1] == b and abs(got[k][0]["cost"] - cost) < 1e-9 and all(q in around(p) for p, q in itertools.pairwise(path))


def test_reroutes_avoid_walls(spark):
    held = {(x, y): x == 5 and y > 0 for x in range(11) for y in range(6)}
    path = [(1, 7, k, k + 0.5, 3.5) for k in range(11)] + [(1, 8, k, k + 0.5, 0.5) for k in range(11)] + [(1, 9, 0, 5.5, 3.5)]
    rows = routing.rerouted(spark.createDataFrame(path, "map long, run long, k long, x double, y double"), routing.clearance(cells_of(spark, held), 3), 1.0, "run", "k").collect()
    at = lambda r: (math.floor(r["x"]), math.floor(r["y"]))
    assert any(r["rerouted"] for r in rows if r["run"] == 7) and not any(held[at(r)] for r in rows if r["run"] in (7, 8))
    assert sum(r["run"] == 8 for r in rows) == 11 and [r["rerouted"] for r in rows if r["run"] == 9] == [False]


def test_matching_equals_trying_all_states(spark):
    rng = random.Random(15)
    seen = [(1, k, k * 2.0 + rng.random(), rng.random() * 3) for k in range(5)]
    options = {k: [(int(x) + a, int(y) + b) for a in (0, 1) for b in (0, 1)] for _, k, x, y in seen}
    rows = [(1, k, cx, cy, cx + 0.5, cy + 0.5) for k, c in options.items() for cx, cy in c]
    got = [(r["cx"], r["cy"]) for r in routing.matched(spark.createDataFrame(seen, "run long, k long, x double, y double"), spark.createDataFrame(rows, "run long, k long, cx long, cy long, wx double, wy double")).orderBy("k").collect()]

    def cost(states):
        w = [(x + 0.5, y + 0.5) for x, y in states]
        total = math.dist(w[0], seen[0][2:]) / 20
        for k in range(1, 5):
            raw = (seen[k][2] - seen[k - 1][2], seen[k][3] - seen[k - 1][3])
            size, length = math.hypot(*raw), math.dist(w[k], w[k - 1])
            head = math.atan2(w[k][1] - w[k - 1][1], w[k][0] - w[k - 1][0]) if length else math.atan2(raw[1], raw[0])
            total += 0.85 * abs(length - size) / max(size, 1) + 0.55 * abs(math.remainder(head - math.atan2(raw[1], raw[0]), 2 * math.pi)) / math.pi + math.dist(w[k], seen[k][2:]) / max(size + 10, 18)
        return total

    assert abs(cost(got) - min(map(cost, itertools.product(*options.values())))) < 1e-9


def test_loops_and_snaps_equal_plain_ones(spark):
    rng = random.Random(16)
    states = [(1, k, rng.randrange(12), rng.randrange(12), rng.uniform(0, 360), rng.choice([None, "a", "b"])) for k in range(60)]
    got = {r["k"]: (r["cx"], r["cy"]) for r in routing.loops_closed(spark.createDataFrame(states, "run long, k long, cx long, cy long, heading double, kind string")).collect()}
    for _, k, x, y, h, kind in states:
        fit = [(math.dist((x, y), (p[2], p[3])), p[1], p[2], p[3]) for p in states if p[1] < k - 3 and math.dist((x, y), (p[2], p[3])) <= 3 and abs(math.remainder(h - p[4], 360)) <= 40 and (kind is None or p[5] is None or kind == p[5])]
        assert got[k] == (min(fit)[2:] if fit else (x, y))
    held = grid(3)
    room = {p: min(4.0, min(math.dist(p, w) for w, o in held.items() if o)) for p in held}
    points = [(1, k, rng.uniform(0, 14), rng.uniform(0, 10)) for k in range(40)]
    snapped = {r["k"]: (r["x"], r["y"]) for r in routing.snapped(spark.createDataFrame(points, "map long, k long, x double, y double"), routing.clearance(cells_of(spark, held), 4), 1.0, ["k"]).collect()}
    for _, k, x, y in points:
        near = [(-(room[c] - 0.35 * math.hypot(a, b)), b, a, c) for b in range(-2, 3) for a in range(-2, 3) if held.get(c := (int(x) + a, int(y) + b)) is False]
        assert snapped[k] == ((min(near)[3][0] + 0.5, min(near)[3][1] + 0.5) if near else (x, y))


# -- plans that must stay linear


def test_neighbours_in_one_long_run_take_seconds(spark):
    n = 200_000
    left = spark.range(n).select(F.lit(1).cast("long").alias("run"), (F.col("id") * 2.0).alias("t"))
    right = spark.range(n).select(F.lit(1).cast("long").alias("run"), (F.col("id") * 2.0 + 1).alias("t"), (F.col("id") * 2.0 + 1).alias("v"))
    began = time.time()
    got = joins.as_of(left, right, "run", "t", "v")
    assert got.filter("abs(v - greatest(t, 1)) > 1e-9").count() == 0
    holes = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("t"), F.col("id"), F.when(F.col("id") % 1000 == 0, F.col("id").cast("double")).alias("v"))
    assert series.gap_fill(holes, "v", "t").filter("abs(v - least(t, 199000)) > 1e-9").count() == 0
    assert time.time() - began < 60


@pytest.mark.parametrize("n", [0, 1, 7, 5000])
def test_percentiles_are_exact(spark, n):
    rng = np.random.default_rng(17)
    values = np.round(rng.normal(0, 3, n), 1)
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = ranking.percentiles(spark.createDataFrame([(v,) for v in values.tolist()] + [(None,)], "v double"), "v", shares).first()["p"]
    assert got == [None] * 5 if not n else np.allclose(got, np.percentile(values, np.array(shares) * 100))
