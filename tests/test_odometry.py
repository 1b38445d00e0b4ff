"""Odometry steps against a plain loop, and what the gates are for."""

import math
import random

import numpy as np

from pathloom.operators import odometry

SCHEMA = "run long, t double, id long, dx double, dy double, turn double, conf double, dx2 double, dy2 double, turn2 double, conf2 double"


def plain(rows):
    """The rules with running sums kept outside: lists of steps first, then one pass of addition."""
    steps, last, before = [], None, None
    for _, t, _, *n in rows:
        sources = [n[k : k + 4] for k in (0, 4) if all(v is not None for v in n[k : k + 4])]
        d, sure = np.zeros(3), 0.0
        if len(sources) == 1:
            d, sure = np.array(sources[0][:3]), sources[0][3]
        elif sources:
            a, b = sources
            if a[2] * b[2] < 0 and abs(a[2]) > 1 and abs(b[2]) > 1:
                if abs(a[3] - b[3]) > 0.12:
                    best = a if a[3] > b[3] else b
                    d, sure = np.array(best[:3]), best[3]
            else:
                w = np.maximum(0.05, [a[3], b[3]])
                d, sure = np.average([a[:3], b[:3]], axis=0, weights=w), max(a[3], b[3])
        speed = np.hypot(d[0], d[1])
        turn = d[2]
        move = d[:2] * (0.35 if abs(turn) > 3 else 1) * (0.15 if abs(turn) > 6 else 1) * (0 if abs(turn) > 8 and speed < 0.03 else 1)
        raw, scale, v = turn, max(1.0, max(1e-3, t - before) if before is not None else 1.0), np.hypot(*move)
        if (abs(turn) > 35 * scale and v > 0.2 * scale) or (sure < 0.15 and v > 0.08 * scale) or (sure < 0.1 and abs(turn) > 8 * scale):
            move, turn = np.zeros(2), 0.0
        v = np.hypot(*move)
        still, spot = v <= 0.018 and abs(turn) <= 0.45, v <= 0.035 and abs(turn) >= 2
        prev = last if last is not None else np.array([*move, turn])
        share = 1.0 if still else 0.85 if spot or abs(raw) < 0.35 else 0.92 if abs(prev[2]) > 1 and abs(raw) > 1 and prev[2] * raw < 0 else 0.4
        along = 0.4 if not still and not spot else 1.0
        last = np.array([*(along * move + (1 - along) * prev[:2]), share * turn + (1 - share) * prev[2]])
        before = t
        steps.append(last)
    steps = np.array(steps)
    heading = np.radians(np.concatenate([[0], np.cumsum(steps[:, 2])[:-1]]))
    x = np.cumsum(steps[:, 0] * np.cos(heading) - steps[:, 1] * np.sin(heading))
    y = np.cumsum(steps[:, 0] * np.sin(heading) + steps[:, 1] * np.cos(heading))
    return np.stack([x, y, np.cumsum(steps[:, 2])], axis=1)


def test_steps_equal_the_plain_loop(spark):
    rng = random.Random(4)
    rows = []
    for run in range(4):
        t = 0.0
        for k in range(300):
            t += rng.choice([0.03, 0.5, 1.0, 4.0])
            one = [rng.uniform(-0.3, 0.5), rng.uniform(-0.1, 0.1), rng.choice([0.1, 1.5, -2.0, 5.0, -7.0, 12.0, 50.0, -45.0]) * rng.random(), rng.random()]
            two = [one[0] + rng.gauss(0, 0.05), one[1], one[2] * rng.choice([1, 1, 1.2, -1]), rng.random()]
            if rng.random() < 0.2:
                one[:3] = [0.001, 0.0, rng.choice([0.1, 5.0])]
            for source in (one, two):
                if rng.random() < 0.15:
                    source[rng.randrange(4)] = None
            rows.append((run, t, k, *one, *two))
    got = odometry.integrated(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    seen = {}
    for r in sorted(got, key=lambda r: (r["run"], r["id"])):
        seen.setdefault(r["run"], []).append((r["x"], r["y"], r["heading"]))
    for run in range(4):
        want = plain([r for r in rows if r[0] == run])
        mine = np.array(seen[run])
        assert np.allclose(mine[:, :2], want[:, :2], atol=1e-9) and np.allclose(np.cos(np.radians(mine[:, 2] - want[:, 2])), 1, atol=1e-9)
    assert {r["source"] for r in got} == {"both", "first", "second", "none", "conflict"} and {r["state"] for r in got} == {"still", "spot", "moving"} and 0 < sum(r["gated"] for r in got) < 600


def test_outliers_are_rejected(spark):
    rows = [(1, float(k), k, 0.1, 0.0, 0.0, 0.9, 0.1, 0.0, 0.0, 0.8) for k in range(200)]
    for k in (20, 77, 130):
        rows[k] = (1, float(k), k, 9.0, 5.0, 80.0, 0.9, 8.0, 5.0, 70.0, 0.9)
    rows[50] = (1, 50.0, 50, 6.0, 6.0, 0.0, 0.05, None, None, None, None)
    got = sorted(odometry.integrated(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r["id"])
    assert [r["id"] for r in got if r["gated"]] == [20, 50, 77, 130]
    assert abs(got[-1]["y"]) < 1e-9 and abs(got[-1]["x"] - 0.1 * 200) < 0.1 * 4 * 3 and math.isclose(got[-1]["heading"], 0, abs_tol=1e-9)
