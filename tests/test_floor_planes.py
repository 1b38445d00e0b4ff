"""Floors of frames that are larger than a block, against a plain version on the whole frame."""

import numpy as np

from pathloom.operators import alignment


def plain(p, frame, rounds=72):
    rng, up = np.random.RandomState(frame + 17), np.array([0.0, 1.0, 0.0])
    near = 0.012 * np.median(np.linalg.norm(p, axis=1))
    best = (-1.0, None)
    for _ in range(rounds):
        a, b, c = p[rng.choice(len(p), 3, replace=False)]
        n = np.cross(b - a, c - a)
        n /= np.linalg.norm(n)
        inside = np.abs((p - a) @ n) <= near
        if abs(n @ up) >= 0.78 and inside.mean() * (n @ up) ** 2 > best[0]:
            best = (inside.mean() * (n @ up) ** 2, inside)
    q = p[best[1]]
    centre = np.median(q, axis=0)
    n = np.linalg.svd(q - centre, full_matrices=False)[2][-1]
    n = -n if n @ up < 0 else n
    height = abs(centre @ n)
    return height, best[1].mean(), n @ up, np.median(np.abs((q - centre) @ n)) / height


def test_no_task_needs_a_whole_frame(spark):
    rng, rows, want = np.random.default_rng(4), [], {}
    for frame in (1, 2):
        floor = np.stack([rng.uniform(-3, 3, 900), 1.6 + rng.normal(0, 0.004, 900), rng.uniform(1, 6, 900)], 1)
        p = rng.permutation(np.concatenate([floor, rng.uniform(-3, 3, (600, 3))]))
        want[frame] = plain(p, frame)
        rows += [(frame, k, *q) for k, q in enumerate(p.tolist())]
    out = alignment.floor_planes(spark.createDataFrame(rows, "frame long, id long, x double, y double, z double"), (0.0, 1.0, 0.0))
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {r["frame"]: (r["height"], r["inliers"], r["alignment"], r["residual"]) for r in out.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)
