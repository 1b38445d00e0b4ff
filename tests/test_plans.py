"""Searches and matching on floor plans against trying everything."""

import itertools
import math
import random

import numpy as np
import pytest

from pathloom.operators import hypotheses, routing, trellis

CELLS = "map long, cx long, cy long, occupied boolean"


def plan(seed, width=16, height=12, share=0.2, plan=1):
    rng = random.Random(seed)
    return {(x, y): rng.random() < share for x in range(width) for y in range(height)}


def cells_of(spark, held, most=6, name=1):
    return routing.clearance(spark.createDataFrame([(name, x, y, o) for (x, y), o in held.items()], CELLS), most)


@pytest.mark.parametrize("seed,share", [(1, 0.02), (2, 0.3), (3, 0.0), (4, 1.0)])
def test_the_distance_transform_is_exact(spark, seed, share):
    held = plan(seed, 23, 17, share)
    del held[3, 3], held[10, 4]  # a cell that is not given counts as free
    got = {(r["cx"], r["cy"]): r["clearance"] for r in cells_of(spark, held, 5).collect()}
    walls = [p for p, o in held.items() if o]
    assert got.keys() == held.keys()
    assert all(abs(got[p] - min([5.0, *(math.dist(p, w) for w in walls)])) < 1e-12 for p in held)


# -- beam search


def plain_scores(route, held, room, turn, start, pace, lattice, ratio=1.08, degrees=5.0):
    out = {}
    for si, yi in lattice:
        a, s = turn + math.radians(degrees) * yi, ratio**si
        at = [(math.floor(start[0] + s * (math.cos(a) * x - math.sin(a) * y)), math.floor(start[1] + s * (math.sin(a) * x + math.cos(a) * y))) for x, y in route]
        n = len(at)
        score = 34 * sum(held.get(p, True) for p in at) / n + 60 * sum(p not in held for p in at) / n + 0.35 * sum(math.exp(-room.get(p, 0) / 0.45) for p in at) / n
        out[si, yi] = round(score + 1.25 * (math.log(pace * s) ** 2 if pace else 0) + 0.08 * abs(yi) * degrees / 5, 9)
    return out


def beam_case(spark, runs):
    held = plan(7, 20, 20, 0.25)
    cells = cells_of(spark, held)
    room = {(r["cx"], r["cy"]): r["clearance"] for r in cells.collect()}
    rng = random.Random(9)
    routes = {r: [(0.0, 0.0)] + [(rng.uniform(-8, 8), rng.uniform(-8, 8)) for _ in range(rng.randint(1, 30))] for r in range(runs)}
    case = {r: (rng.uniform(-3, 3), (rng.uniform(3, 17), rng.uniform(3, 17)), rng.choice([None, 0.7, 1.2])) for r in routes}
    rows = [(1, r, *p, *case[r][1], case[r][0], 1.0, case[r][2]) for r, route in routes.items() for p in route]
    return held, cells, room, routes, case, spark.createDataFrame(rows, "map long, run long, dx double, dy double, sx double, sy double, turn double, base double, pace double")


def test_a_wide_beam_is_exhaustive(spark):
    held, cells, room, routes, case, samples = beam_case(spark, 6)
    got = hypotheses.searched(samples, cells, width=10_000, strides=(4, 2, 1), scales=4, yaws=6).collect()
    points = list(itertools.product(range(-4, 5), range(-6, 7)))
    for r, route in routes.items():
        want = sorted((s, abs(y), y, k) for (k, y), s in plain_scores(route, held, room, case[r][0], case[r][1], case[r][2], points).items())
        mine = sorted((x for x in got if x["run"] == r), key=lambda x: x["place"])
        assert len(mine) == len(points) and np.allclose([x["score"] for x in mine], [w[0] for w in want], atol=1e-6)
        assert mine[0]["margin"] >= 0 and mine[-1]["margin"] is None and abs(mine[0]["margin"] - (want[1][0] - want[0][0])) < 1e-6


def test_a_narrow_beam_equals_the_plain_beam(spark):
    held, cells, room, routes, case, samples = beam_case(spark, 5)
    got = hypotheses.searched(samples, cells, width=3, strides=(4, 2, 1), scales=8, yaws=12).collect()
    for r, route in routes.items():
        frontier = [(k, y) for k in range(-8, 9, 4) for y in range(-12, 13, 4)]
        for stride in (None, 2, 1):
            if stride:
                frontier = {(k + a, y + b) for k, y in frontier for a in (-stride, 0, stride) for b in (-stride, 0, stride) if abs(k + a) <= 8 and abs(y + b) <= 12}
            scores = plain_scores(route, held, room, *case[r][:2], case[r][2], frontier)
            frontier = [(k, y) for s, _, y, k in sorted((s, abs(y), y, k) for (k, y), s in scores.items())[:3]]
        assert [(x["scale_step"], x["yaw_step"]) for x in sorted((x for x in got if x["run"] == r), key=lambda x: x["place"])] == frontier


def test_a_shrunken_turned_route_is_found(spark):
    held = {(x, y): not (8 <= y <= 10 or 20 <= x <= 22) for x in range(30) for y in range(30)}
    route = [(1.0 * k, 0.0) for k in range(20)] + [(19.0, 1.0 * k) for k in range(1, 18)]
    a, s = math.radians(-20), 1 / 1.08**4
    samples = [(1, 5, s * (math.cos(a) * x - math.sin(a) * y), s * (math.sin(a) * x + math.cos(a) * y), 2.5, 9.5, 0.0, 1.0, None) for x, y in route]
    best = hypotheses.searched(spark.createDataFrame(samples, "map long, run long, dx double, dy double, sx double, sy double, turn double, base double, pace double"), cells_of(spark, held)).filter("place = 0").first()
    assert abs(best["yaw_step"] - 4) <= 1 and abs(best["scale_step"] - 4) <= 1 and best["collision"] < 0.05 and best["outside"] == 0


# -- second-order matching


def plain_match(seen, states, held, size, wide):
    """The cheapest sequence of states by trying all, None where none is reachable."""

    def clear(a, b):
        n = max(1, math.ceil(2 * math.dist(a, b) / size))
        return not any(held.get((math.floor((a[0] + (b[0] - a[0]) * s / n) / size), math.floor((a[1] + (b[1] - a[1]) * s / n) / size)), True) for s in range(n + 1))

    def angle(u, v):
        return math.atan2(u[0] * v[1] - u[1] * v[0], u[0] * v[0] + u[1] * v[1])

    best = None
    for chosen in itertools.product(*states):
        total, ok = 0.0, True
        for k, (far, _, _, wx, wy, room) in enumerate(chosen):
            total += 0.7 * (far / wide) ** 2 + 0.08 * math.exp(-room / 0.45)
            if k:
                a, b = chosen[k - 1][3:5], (wx, wy)
                if not clear(a, b):
                    ok = False
                    break
                u, v = np.subtract(seen[k], seen[k - 1]), np.subtract(b, a)
                lu, lv = max(np.hypot(*u), 1e-6), max(np.hypot(*v), 1e-6)
                total += 1.35 * abs(math.log(lv / lu)) + 1.7 * (1 - min(1, max(-1, float(u @ v) / (lu * lv))))
                if k > 1:
                    u0, v0 = np.subtract(seen[k - 1], seen[k - 2]), np.subtract(a, chosen[k - 2][3:5])
                    before = max(np.hypot(*v0), 1e-6) / max(np.hypot(*u0), 1e-6)
                    x, y = angle(u0, u), angle(v0, v)
                    total += 0.8 * abs(math.log(max(lv / lu / before, 1e-12))) + 1.2 * abs(math.remainder(y - x, 2 * math.pi)) / math.pi
                    total += 1.5 * (abs(x) >= math.radians(12) and abs(y) >= math.radians(12) and x * y < 0) + 2.0 * (abs(y) >= math.radians(150) and abs(x) <= math.radians(90))
        if ok and (best is None or total < best[0]):
            best = (total, [c[1:3] for c in chosen])
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_second_order_matching_equals_trying_all(spark, seed):
    rng = random.Random(seed)
    held = plan(seed + 20, 16, 12, 0.2)
    cells = cells_of(spark, held)
    seen = {}
    for r in range(8):
        x, y, path = rng.uniform(2, 12), rng.uniform(2, 9), []
        for _ in range(6):
            path.append((x, y))
            x, y = min(15.4, max(0.4, x + rng.uniform(-1, 2))), min(11.4, max(0.4, y + rng.uniform(-1.5, 1.5)))
        seen[r] = path
    rows = [(1, r, 10 * k, *p) for r, path in seen.items() for k, p in enumerate(path)]
    obs = spark.createDataFrame(rows, "map long, run long, k long, x double, y double")
    states = {(r["run"], r["k"] // 10): [tuple(s) for s in r["states"]] for r in trellis.candidates(obs, cells, 1.0, 1, 4).collect()}
    got = {}
    for r in trellis.matched(obs, cells, 1.0, 1, 4).collect():
        got.setdefault(r["run"], []).append(r)
    tried = 0
    for run, path in seen.items():
        mine = sorted(got.get(run, []), key=lambda r: r["k"])
        if len(mine) < 6 or any(r["piece"] for r in mine):
            continue
        want = plain_match(path, [states[run, k] for k in range(6)], held, 1.0, 2.0)
        tried += 1
        assert abs(mine[0]["objective"] - want[0]) < 1e-9 and [(r["cx"], r["cy"]) for r in mine] == want[1]
    assert tried >= 3


def test_a_wall_parts_a_run_and_long_runs_pass(spark):
    held = {(x, y): x == 6 for x in range(400) for y in range(3)}
    rows = [(1, 1, k, k + 0.5, 1.5) for k in range(400)] + [(1, 2, 0, 3.5, 1.5), (1, 3, 0, 6.5, 50.0)]
    got = trellis.matched(spark.createDataFrame(rows, "map long, run long, k long, x double, y double"), cells_of(spark, held), 1.0).collect()
    one = sorted((r["k"], r["cx"], r["cy"], r["piece"]) for r in got if r["run"] == 1)
    assert len(one) == 400 and {p for *_, p in one} == {0, 1} and all(p == (k > 6) or abs(k - 6) <= 1 for k, _, _, p in one)
    assert sum(cx == k and cy == 1 for k, cx, cy, _ in one) > 380 and not any(held[cx, cy] for _, cx, cy, _ in one)
    assert [(r["cx"], r["cy"], r["piece"]) for r in got if r["run"] == 2] == [(3, 1, 0)] and not any(r["run"] == 3 for r in got)


@pytest.mark.parametrize("name", ["plan_snapped", "plan_matched", "plan_regions", "plan_clearance"])
def test_exploded_tables_are_not_broadcast(spark, name):
    """Spark's estimate takes an exploded table for small at any size."""
    from pathloom.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
