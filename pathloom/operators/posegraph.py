"""Robust optimisation of pose graphs, in blocks of frames.

Poses are camera to world, Q and c; an edge (i, j, M, m) wants Q_j = Q_i M^T and
c_j = c_i - Q_j m. The start is composed along a spanning tree of the nearest and
surest edges, so the given poses count by the first frame of each connected part
only. Then rotations and, with these fixed, positions are corrected in rounds: each
is a least-squares problem on the graph's weighted Laplacian, whose weights belong
to a truncated loss that goes from convex to tight.

A task's call takes many blocks. In a round each block eliminates its frames against
those with edges to other blocks; these few are solved per run in a second pass, and
the blocks fill in their own. Blocks without such edges are done at once. A run whose
fitted edges agree along its tree up to rounding needs no round: no weight and no
correction could change. The rounds of the others keep blocks and answers in the
shared folder.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, stored
from .sparse import eliminated, laplacian, solved

BLOCK = 256
#: Frames that one call takes, about.
FRAMES_A_CALL = 8192
#: Calls that one task makes.
CALLS_A_TASK = 16
#: A block's result, a row a frame.
FRAME_COLUMNS = ["block", "frame", "old", "s0", "new", "s1", "n", "largest", "cost", "ends"]
FRAME_SCHEMA = "block long, frame long, old array<double>, s0 double, new array<double>, s1 double, n long, largest long, cost array<double>, ends array<double>"
#: An edge fits up to rounding within this angle, this share of its size and this share of its ends' distance from the origin.
FITS, ROUNDING = 1e-9, 1e-14
#: Where a residual counts as wrong: an angle in degrees, a distance in sizes of the edge.
ANGLE_LIMIT, SHIFT_LIMIT = 10.0, 0.5
ROUNDS = 8
#: The loss goes from nearly convex for residuals of so many limits to nearly the truncated one.
LARGEST, SHARPEST = 30.0, 30.0
#: What a tree edge keeps of its weight, so that no part comes loose.
TREE_SHARE = 1e-3
#: One edge in so many is held out; it is not fitted and must not fit worse in the end.
HELD_OUT = 10
#: The range of weights about their median, and the gates.
WEIGHTS = (0.1, 10.0)
LOCAL_GAP = 10
LEAST_GAIN = 0.02
#: A loss below this is none.
EXACT = 1e-9
LEAST_COVERAGE = 0.95
LENGTH_RATIO = (0.5, 1.5)
MOST_STEP_RATIO = 3.0
MOST_INLIER_DROP = 0.05


def log(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of a stack of rotations."""
    skew = np.stack([r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]], axis=1) / 2
    sine, cosine = np.linalg.norm(skew, axis=1), (np.trace(r, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sine, cosine)
    out = skew * (angle / np.where(sine > 1e-12, sine, 1))[:, None]
    half = (sine <= 1e-6) & (cosine < 0)  # half a turn: the axis is the largest column of R + I
    if half.any():
        sums = r[half] + np.eye(3)
        axis = np.take_along_axis(sums, np.linalg.norm(sums, axis=1).argmax(axis=1)[:, None, None], axis=2)[:, :, 0]
        out[half] = axis / np.linalg.norm(axis, axis=1)[:, None] * angle[half][:, None]
    return out


def exp(v: np.ndarray) -> np.ndarray:
    """Rotations of a stack of rotation vectors."""
    angle = np.linalg.norm(v, axis=1)
    k = np.zeros((len(v), 3, 3))
    k[:, 2, 1], k[:, 0, 2], k[:, 1, 0] = v.T
    k = k - np.swapaxes(k, 1, 2)
    small = angle < 1e-8
    a = np.where(small, 1, np.sin(angle) / np.where(small, 1, angle))
    b = np.where(small, 0.5, (1 - np.cos(angle)) / np.where(small, 1, angle) ** 2)
    return np.eye(3) + a[:, None, None] * k + b[:, None, None] * (k @ k)


class Edges:
    """Edges as arrays: ends i and j (places of nodes), rotation m, shift s, weight w, size, and whether held out or of the tree."""

    FIELDS = ("i", "j", "m", "s", "w", "size", "held", "tree")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    def __len__(self):
        return len(self.i)

    def at(self, rows) -> Edges:
        return Edges(**{f: getattr(self, f)[rows] for f in self.FIELDS})

    def turns(self, q: np.ndarray) -> np.ndarray:
        """What rotations leave: the vectors by which j still has to turn against i."""
        return log(q[self.i] @ np.swapaxes(self.m, 1, 2) @ np.swapaxes(q[self.j], 1, 2))

    def shifts(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        return c[self.i] - c[self.j] - np.einsum("nab,nb->na", q[self.j], self.s)

    def wanted(self, q: np.ndarray, c: np.ndarray, turn: bool, sharp: float) -> tuple[np.ndarray, np.ndarray]:
        """What is left to correct and the weights of a round; a held-out edge has none."""
        left = self.turns(q) if turn else self.shifts(q, c)
        far = np.linalg.norm(left, axis=1) / (math.radians(ANGLE_LIMIT) if turn else SHIFT_LIMIT * self.size)
        near, end = math.sqrt(sharp / (sharp + 1)), math.sqrt((sharp + 1) / sharp)
        share = np.where(far <= near, 1.0, np.where(far >= end, 0.0, math.sqrt(sharp * (sharp + 1)) / np.maximum(far, 1e-12) - sharp))
        share = np.where(self.tree, np.maximum(share, TREE_SHARE), share)
        return left, np.where(self.held, 0.0, self.w * share / (1 if turn else self.size**2))

    def fit(self, q: np.ndarray, c: np.ndarray) -> bool:
        """Whether the fitted edges leave rounding only, so that no round would move a pose."""
        own = self.at(~self.held)
        room = FITS * own.size + ROUNDING * (np.abs(c[own.i]).max(axis=1) + np.abs(c[own.j]).max(axis=1))
        return bool((np.linalg.norm(own.turns(q), axis=1) <= FITS).all() and (np.linalg.norm(own.shifts(q, c), axis=1) <= room).all())

    def cost(self, q: np.ndarray, c: np.ndarray) -> np.ndarray:
        """(weight, weighted truncated loss, weighted inliers) of the fitted edges, then of those held out."""
        angle = np.linalg.norm(self.turns(q), axis=1) / math.radians(ANGLE_LIMIT)
        shift = np.linalg.norm(self.shifts(q, c), axis=1) / (SHIFT_LIMIT * self.size)
        loss, good = np.minimum(1, (angle**2 + shift**2) / 2), (angle < 1) & (shift < 1)
        return np.array([(self.w * v)[own].sum() for own in (~self.held, self.held) for v in (np.ones(len(self)), loss, good)])


def sharpness(round_: int) -> float:
    least = 1 / (2 * LARGEST**2 - 1)
    return least * (SHARPEST / least) ** (round_ / (ROUNDS - 1))


def spanning(n: int, edges: Edges, gap: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Part of each node, and per node the (neighbour, edge) of a tree that takes the shortest, then surest edges."""
    part = list(range(n))

    def root(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for e in np.lexsort((-edges.w, gap)).tolist():
        i, j = int(edges.i[e]), int(edges.j[e])
        a, b = root(i), root(j)
        if a != b:
            part[max(a, b)] = min(a, b)
            near[i].append((j, e))
            near[j].append((i, e))
            edges.tree[e] = True
    return np.array([root(k) for k in range(n)], int), near


def composed(q: np.ndarray, c: np.ndarray, roots, near, step) -> None:
    """Follow the tree from the roots; step(from, to, edge) gives a node's pose in place."""
    for r in roots:
        todo = [r]
        seen = {r}
        while todo:
            x = todo.pop()
            for y, e in near[x]:
                if y not in seen:
                    seen.add(y)
                    step(x, y, e)
                    todo.append(y)


def _next(q_i, c_i, m, s):
    q = q_i @ m.T
    return q, c_i - q @ s


def _before(q_j, c_j, m, s):
    return q_j @ m, c_j + q_j @ s


# -- one block


def opened(frames: np.ndarray, q: np.ndarray, c: np.ndarray, edges: Edges, gap: np.ndarray, half: list[dict], block: int) -> tuple[dict, dict]:
    """A block's state, and its report for the run: the frames that others see, in parts that hang together."""
    part, near = spanning(len(frames), edges, gap)
    edges.held &= ~edges.tree
    rel_q, rel_c = np.tile(np.eye(3), (len(frames), 1, 1)), np.zeros((len(frames), 3))

    def step(x, y, e):
        move = _next if edges.i[e] == x else _before
        rel_q[y], rel_c[y] = move(rel_q[x], rel_c[x], edges.m[e], edges.s[e])

    composed(rel_q, rel_c, np.unique(part).tolist(), near, step)
    place = {f: k for k, f in enumerate(frames.tolist())}
    seen = {place[f] for h in half for f in (h["i"], h["j"]) if f in place}
    boundary = np.array(sorted(seen | {0}), int)
    state = {"frames": frames, "q0": q, "c0": c, "q": q.copy(), "c": c.copy(), "edges": edges, "part": part, "boundary": boundary, "rel_q": rel_q, "rel_c": rel_c}
    sizes = np.bincount(part, minlength=len(frames))
    shown = np.unique(part[boundary])
    report = {
        "block": block, "frames": frames[boundary], "part": part[boundary], "rel_q": rel_q[boundary], "rel_c": rel_c[boundary], "q": q[boundary], "c": c[boundary],
        "sizes": {int(p): int(sizes[p]) for p in shown}, "alone": int(np.delete(sizes, shown).max(initial=0)), "n": len(frames),
        "half": [h for h in half if h["i"] in place], "fits": edges.fit(rel_q, rel_c),
    }
    # Parts that nobody else sees keep their first frame.
    for p in np.setdiff1d(part, shown):
        own = part == p
        state["q"][own], state["c"][own] = placed(rel_q[own], rel_c[own], q[p], c[p])
    return state, report


def origin(q, c, at_q, at_c):
    """Where a part stands whose node with relative pose (at_q, at_c) has pose (q, c)."""
    turn = q @ at_q.T
    return turn, c - turn @ at_c


def placed(rel_q, rel_c, turn, c):
    """Poses of a part's nodes where it stands at (turn, c)."""
    return turn @ rel_q, c + rel_c @ turn.T


def reduced(state: dict, turn: bool, sharp: float) -> dict:
    """Eliminate a block's frames for a round; the rest goes to the run."""
    edges, q, n = state["edges"], state["q"], len(state["frames"])
    want, w = edges.wanted(q, state["c"], turn, sharp)
    a, b = laplacian(n, edges.i, edges.j, w, want)
    hidden = np.setdiff1d(state["part"], state["part"][state["boundary"]])
    a[hidden, hidden] += w.sum() + 1  # their first frames stay
    s, r, state["g"], state["h"] = eliminated(a, b, state["boundary"])
    return {"s": s, "r": r}


def filled(state: dict, x: np.ndarray, turn: bool) -> None:
    """Correct a block's poses once its boundary's corrections x are known."""
    step = np.zeros((len(state["frames"]), 3))
    step[state["boundary"]] = x
    step[np.setdiff1d(np.arange(len(step)), state["boundary"])] = state["h"] - state["g"] @ x
    if turn:
        state["q"] = exp(step) @ state["q"]
    else:
        state["c"] = state["c"] + step


def costs(state: dict) -> np.ndarray:
    return np.concatenate([state["edges"].cost(state["q0"], state["c0"]), state["edges"].cost(state["q"], state["c"])])


def alone(state: dict) -> None:
    """All rounds of a block that no other one sees: its first frame stays."""
    own = state["part"] == state["part"][0]
    state["q"][own], state["c"][own] = placed(state["rel_q"][own], state["rel_c"][own], state["q0"][0], state["c0"][0])
    if state["edges"].fit(state["q"], state["c"]):
        return
    for turn in (True, False):
        for k in range(ROUNDS):
            reduced(state, turn, sharpness(k))
            filled(state, np.zeros((1, 3)), turn)


# -- one run's frames between blocks


def tied(reports: list[dict]) -> tuple[dict, list[tuple[int, list]]]:
    """A run's state from its blocks' reports, and each block's parts with their poses."""
    reports = sorted(reports, key=lambda r: r["block"])
    frames = np.concatenate([r["frames"] for r in reports])
    place = {f: k for k, f in enumerate(frames.tolist())}
    names = [(r["block"], int(p)) for r in reports for p in r["part"]]
    number = {p: k for k, p in enumerate(dict.fromkeys(names))}
    part = np.array([number[p] for p in names], int)
    q, c, rel_q, rel_c = (np.concatenate([r[f] for r in reports]) for f in ("q", "c", "rel_q", "rel_c"))
    half = [h for r in reports for h in r["half"] if h["i"] in place and h["j"] in place]
    ends = np.array([[place[h["i"]], place[h["j"]]] for h in half], int).reshape(-1, 2)
    edges = edge_arrays(half, ends[:, 0], ends[:, 1])
    over = Edges(i=part[ends[:, 0]], j=part[ends[:, 1]], w=edges.w, tree=edges.tree)
    whole, near = spanning(len(number), over, np.array([h["gap"] for h in half], int))
    edges.held &= ~edges.tree
    part_q, part_c = np.tile(np.eye(3), (len(number), 1, 1)), np.zeros((len(number), 3))
    known = {r["block"]: r["sizes"] for r in reports}
    sizes = np.bincount(whole, [known[b][p] for b, p in number], minlength=len(number))
    pins = np.array([int(np.flatnonzero(whole[part] == g)[0]) for g in np.unique(whole)], int)

    def step(x, y, e):
        a, b, m, s = int(edges.i[e]), int(edges.j[e]), edges.m[e], edges.s[e]
        from_, to, move = (a, b, _next) if part[a] == x else (b, a, _before)
        new = move(part_q[x] @ rel_q[from_], part_c[x] + part_q[x] @ rel_c[from_], m, s)
        part_q[y], part_c[y] = origin(*new, rel_q[to], rel_c[to])

    for p in pins.tolist():
        g = int(part[p])
        part_q[g], part_c[g] = origin(q[p], c[p], rel_q[p], rel_c[p])
        composed(part_q, part_c, [g], near, step)
    state = {
        "q0": q, "c0": c, "q": part_q[part] @ rel_q, "c": part_c[part] + np.einsum("nab,nb->na", part_q[part], rel_c), "edges": edges, "pins": pins,
        "fits": all(r["fits"] for r in reports), "blocks": [(r["block"], len(r["frames"])) for r in reports], "largest": int(max(sizes.max(), max(r["alone"] for r in reports))), "n": sum(r["n"] for r in reports),
    }
    state["fits"] = state["fits"] and edges.fit(state["q"], state["c"])
    return state, [(r["block"], [(int(p), part_q[number[r["block"], int(p)]], part_c[number[r["block"], int(p)]]) for p in np.unique(r["part"])]) for r in reports]


def answered(state: dict, reports: dict[int, dict], turn: bool, sharp: float) -> list[tuple[int, np.ndarray]]:
    """Solve a run's frames between blocks for a round; each block's corrections."""
    edges, n = state["edges"], len(state["q"])
    want, w = edges.wanted(state["q"], state["c"], turn, sharp)
    i, j, a = [edges.i, edges.j, edges.i, edges.j], [edges.i, edges.j, edges.j, edges.i], [w, w, -w, -w]
    b = np.zeros((n, 3))
    np.add.at(b, edges.j, w[:, None] * want)
    np.add.at(b, edges.i, -w[:, None] * want)
    start, spans = 0, []
    for block, many in state["blocks"]:
        at = np.arange(start, start + many)
        i.append(np.repeat(at, many))
        j.append(np.tile(at, many))
        a.append(reports[block]["s"].reshape(-1))
        b[at] += reports[block]["r"]
        spans.append((block, at))
        start += many
    i.append(state["pins"])
    j.append(state["pins"])
    a.append(np.full(len(state["pins"]), 1e3 * (1 + sum(np.abs(v).max(initial=0) for v in a))))
    x = solved(n, *map(np.concatenate, (i, j, a)), b)
    x[state["pins"]] = 0  # what is left of them is rounding
    if turn:
        state["q"] = exp(x) @ state["q"]
    else:
        state["c"] = state["c"] + x
    return [(block, x[at]) for block, at in spans]


# -- Spark


def edge_arrays(rows: list[dict], i: np.ndarray, j: np.ndarray) -> Edges:
    of = lambda f, *shape: np.array([r[f] for r in rows], float).reshape(-1, *shape)
    return Edges(i=i, j=j, m=of("rotation", 3, 3), s=of("shift", 3), w=of("weight"), size=of("size"), held=of("held").astype(bool), tree=np.zeros(len(rows), bool))


def prepared(edges: DataFrame, run: str) -> DataFrame:
    """Edges (run, i, j, rotation, shift, weight, gap, size, held) with i < j, once a pair: the surest, then the smallest numbers."""
    finite = lambda c: F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = edges.select(run, F.col("i").cast("long"), F.col("j").cast("long"), F.col("rotation").cast("array<double>"), F.col("shift").cast("array<double>"), F.col("weight").cast("double"))
    good = good.filter((F.col("i") != F.col("j")) & (F.col("weight") > 0) & (F.col("weight") < float("inf")) & (F.size("rotation") == 9) & (F.size("shift") == 3) & finite("rotation") & finite("shift"))
    m, s = (lambda k: F.col("rotation")[k]), (lambda k: F.col("shift")[k])
    turned, back = F.array(*[m(3 * c + r) for r in range(3) for c in range(3)]), F.array(*[-(m(r) * s(0) + m(3 + r) * s(1) + m(6 + r) * s(2)) for r in range(3)])
    later = F.col("i") > F.col("j")
    one = good.select(run, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.struct("weight", F.when(later, turned).otherwise(F.col("rotation")).alias("rotation"), F.when(later, back).otherwise(F.col("shift")).alias("shift")).alias("e"))
    one = one.groupBy(run, "i", "j").agg(F.max("e").alias("e")).select(run, "i", "j", "e.*").withColumn("gap", F.col("j") - F.col("i"))
    norm = F.sqrt(s(0) ** 2 + s(1) ** 2 + s(2) ** 2)
    one = stored(one.withColumn("norm", norm), "pairs")
    # Medians by sketch, exact up to 10,000 edges a run.
    unit = F.when((F.col("gap") <= LOCAL_GAP) & (F.col("norm") > 1e-8), F.col("norm") / F.col("gap"))
    scale = one.groupBy(run).agg(F.percentile_approx("weight", 0.5, 10_000).alias("middle"), F.coalesce(F.percentile_approx(unit, 0.5, 10_000), F.lit(1.0)).alias("unit"))
    scale = stored(scale, "scale")  # of known size: with few runs the edges are not shuffled for it
    held = F.pmod(F.xxhash64(F.col(run), F.col("i"), F.col("j")), F.lit(HELD_OUT)) == 0
    weight = F.least(F.lit(WEIGHTS[1]), F.greatest(F.lit(WEIGHTS[0]), F.col("weight") / F.col("middle"))) / F.col("gap")
    size = F.greatest("norm", F.col("unit") * F.sqrt(F.col("gap").cast("double")), F.lit(1e-8))
    return one.join(scale, run).select(run, "i", "j", "rotation", "shift", weight.alias("weight"), "gap", size.alias("size"), held.alias("held"))


def optimise(poses: DataFrame, edges: DataFrame, run: str = "run", block: int = BLOCK) -> DataFrame:
    """Optimised poses (run, frame, pose, accepted, gain) of poses (run, frame, pose) and edges (run, i, j, rotation, shift, weight).

    Poses are camera to world, 16 numbers row by row; an edge's nine and three
    numbers take camera i to camera j. Edges with a missing frame, a self pair,
    or a weight or number that is not finite are left out, and of edges of one
    pair the surest stays. Frames must be distinct in a run. One edge in ten is
    not fitted. A candidate is accepted where the truncated loss of the fitted
    edges falls by 2 % and that of the others doesn't rise, one part holds
    95 % of the frames, the path's length stays within half and one and a half,
    its p99 step within three times, and inliers don't drop by over 5 %;
    otherwise the poses come back as they were, as they do without edges.
    """
    kind = poses.schema[run].dataType.simpleString()
    at = lambda c: F.floor(F.col(c) / block)
    nodes = poses.filter(F.col(run).isNotNull()).select(run, F.col("frame").cast("long").alias("frame"), "pose", at("frame").alias("block"))
    links = prepared(edges, run)
    links = links.withColumn("block", F.explode(F.array_distinct(F.array(at("i"), at("j"))))).withColumn("half", at("i") != at("j"))
    calls = -(-nodes.count() // FRAMES_A_CALL) or 1
    tasks = max(int(poses.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-calls // CALLS_A_TASK))
    called = lambda df: df.withColumn("call", F.pmod(F.xxhash64(run, "block"), F.lit(calls))).repartition(tasks, "call").groupBy("call")

    def open_kernel(key, rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows, links = rows.sort_values([run, "block", "frame"]), links.sort_values([run, "block", "i", "j"])
        pose = _stack(rows["pose"], 4, 4)
        every = {f: links[f].to_numpy() for f in ("i", "j", "weight", "size", "held", "gap", "half")} | {"rotation": _stack(links["rotation"], 3, 3), "shift": _stack(links["shift"], 3)}
        spans, all_frames = dict(_spans(links, run)), rows["frame"].to_numpy()
        for (r, b), own in _spans(rows, run):
            frames = all_frames[own]
            have = {f: v[spans.get((r, b), slice(0, 0))] for f, v in every.items()}
            half = [dict(zip(have, values, strict=True)) for values in zip(*(v[have["half"].astype(bool)] for v in have.values()), strict=True)]
            ends = np.stack([have["i"], have["j"]], axis=1).astype(np.int64)
            place = np.searchsorted(frames, ends)
            inside = ~have["half"].astype(bool) & (frames[np.minimum(place, len(frames) - 1)] == ends).all(axis=1)
            edges = Edges(i=place[inside, 0], j=place[inside, 1], m=have["rotation"][inside], s=have["shift"][inside], w=have["weight"][inside], size=have["size"][inside], held=have["held"][inside].astype(bool), tree=np.zeros(int(inside.sum()), bool))
            state, report = opened(frames, pose[own, :3, :3].copy(), pose[own, :3, 3].copy(), edges, have["gap"][inside].astype(int), half, int(b))
            if not half:
                alone(state)
                out.append(_frames(r, b, state, costs(state)))
                continue
            base = {f: state[f] for f in ("frames", "q0", "c0", "part", "boundary", "rel_q", "rel_c")}
            base["cost"] = np.concatenate([edges.cost(state["q0"], state["c0"]), edges.cost(state["rel_q"], state["rel_c"])])
            out.append(pd.DataFrame([[r, b, pickle.dumps(base), pickle.dumps(edges), pickle.dumps(report)]], columns=[run, "block", "base", "edges", "report"]))
        out = [o.rename(columns={"run": run}) for o in out] or [pd.DataFrame()]
        out = pd.concat(out, ignore_index=True).reindex(columns=[run, *FRAME_COLUMNS, "base", "edges", "report"]).astype({"frame": "Int64", "block": "Int64", "n": "Int64", "largest": "Int64"})
        for c in ("old", "new", "cost", "ends", "base", "edges", "report"):  # what a row lacks is null, not NaN
            out[c] = out[c].astype(object).where(out[c].notna(), None)
        return out

    found = f"{run} {kind}, {FRAME_SCHEMA}"
    blocks = stored(called(nodes).cogroup(called(links)).applyInPandas(open_kernel, f"{found}, base binary, edges binary, report binary"), "blocks")
    done = [blocks.filter("frame is not null").select(run, *FRAME_COLUMNS)]
    live = blocks.filter("report is not null")
    if not live.limit(1).count():
        return _judged(done[0], None, run, kind)

    def tie(key, rows: pd.DataFrame) -> pd.DataFrame:
        state, parts = tied([pickle.loads(r) for r in rows["report"]])
        return pd.DataFrame([[key[0], b, pickle.dumps(p), state["fits"]] for b, p in parts] + [[key[0], None, pickle.dumps(state), state["fits"]]], columns=[run, "block", "data", "fits"]).astype({"block": "Int64"})

    def settle(key, rows: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(data):
            return pd.DataFrame(columns=[run, *FRAME_COLUMNS])
        state = _put(pickle.loads(rows["base"].iloc[0]), pickle.loads(data["data"].iloc[0]))
        return _frames(*key, state, state["cost"]).rename(columns={"run": run})

    def advance(last, turn, sharp):
        def kernel(key, rows: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(data):
                return pd.DataFrame(columns=[run, "block", "state", "report"] if turn is not None else [run, *FRAME_COLUMNS])
            given = pickle.loads(data["data"].iloc[0])
            if last is None:
                state = _put(pickle.loads(rows["base"].iloc[0]), given) | {"edges": pickle.loads(rows["edges"].iloc[0])}
            else:
                state = pickle.loads(rows["state"].iloc[0])
                filled(state, given, last)
            if turn is None:
                return _frames(*key, state, costs(state)).rename(columns={"run": run})
            report = reduced(state, turn, sharp)
            return pd.DataFrame([[*key, pickle.dumps(state), pickle.dumps(report)]], columns=[run, "block", "state", "report"])

        return kernel

    def solve(turn, sharp):
        def kernel(key, rows: pd.DataFrame) -> pd.DataFrame:
            own = rows["block"].isna()
            state = pickle.loads(rows["data"][own].iloc[0])
            reports = {int(b): pickle.loads(d) for b, d in zip(rows["block"][~own], rows["data"][~own], strict=True)}
            parts = answered(state, reports, turn, sharp)
            return pd.DataFrame([[key[0], b, pickle.dumps(p)] for b, p in parts] + [[key[0], None, pickle.dumps(state)]], columns=[run, "block", "data"]).astype({"block": "Int64"})

        return kernel

    answer = f"{run} {kind}, block long, data binary"
    tied_up = stored(live.select(run, "block", "report").groupBy(run).applyInPandas(tie, f"{answer}, fits boolean"), "answers")
    own = tied_up.filter("block is not null")
    done.append(live.select(run, "block", "base").groupBy(run, "block").cogroup(own.filter("fits").groupBy(run, "block")).applyInPandas(settle, found))
    between = tied_up.filter("block is null and fits").select(run, "data")
    answers = tied_up.filter("not fits").select(run, "block", "data")
    if answers.limit(1).count():
        live = live.join(answers.select(run).distinct(), run, "left_semi").select(run, "block", "base", "edges")
        last, spent, before = None, None, None
        for turn, k in [(turn, k) for turn in (True, False) for k in range(ROUNDS)]:
            sharp = sharpness(k)
            given = answers.filter("block is not null").groupBy(run, "block")
            live = stored(live.groupBy(run, "block").cogroup(given).applyInPandas(advance(last, turn, sharp), f"{run} {kind}, block long, state binary, report binary"), "states")
            drop_stored(*filter(None, [spent]))
            asked = live.select(run, "block", F.col("report").alias("data")).union(answers.filter("block is null"))
            answers = stored(asked.groupBy(run).applyInPandas(solve(turn, sharp), answer), "answers")
            drop_stored(*filter(None, [before]))
            last, spent, before = turn, live, answers
        given = answers.filter("block is not null").groupBy(run, "block")
        done.append(live.select(run, "block", "state").groupBy(run, "block").cogroup(given).applyInPandas(advance(last, None, None), found))
        between = between.union(answers.filter("block is null").select(run, "data"))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    out = stored(out, "poses")
    drop_stored(blocks)
    return _judged(out, between, run, kind)


def _stack(column: pd.Series, *shape: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, *shape)


def _spans(rows: pd.DataFrame, run: str):
    """((run, block), slice) of every block in rows sorted by both."""
    r, b = rows[run].to_numpy(), rows["block"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (b[1:] != b[:-1])])) if len(rows) else []
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        yield (r[lo], b[lo]), slice(lo, hi)


def _put(state: dict, parts: list) -> dict:
    """A block's state with its parts where the run has placed them."""
    state["q"], state["c"] = state["q0"].copy(), state["c0"].copy()
    for p, q, c in parts:
        own = state["part"] == p
        state["q"][own], state["c"][own] = placed(state["rel_q"][own], state["rel_c"][own], q, c)
    return state


def _frames(r, b, state: dict, cost: np.ndarray) -> pd.DataFrame:
    """A block's frames with both poses and their steps; its sums and its ends' positions stand in the first row."""
    n = len(state["frames"])
    out = {"run": [r] * n, "block": [b] * n, "frame": state["frames"]}
    for name, step, q, c in (("old", "s0", "q0", "c0"), ("new", "s1", "q", "c")):
        out[name] = list(np.concatenate([state[q], state[c][:, :, None]], axis=2).reshape(n, 12))
        out[step] = np.concatenate([[np.nan], np.linalg.norm(np.diff(state[c], axis=0), axis=1)])
    first = lambda v: [v] + [None] * (n - 1)
    ends = np.concatenate([state[c][k] for c in ("c0", "c") for k in (0, -1)])
    return pd.DataFrame(out | {"n": first(n), "largest": first(int(np.bincount(state["part"]).max())), "cost": first(cost), "ends": first(ends)})


def _judged(frames: DataFrame, between: DataFrame | None, run: str, kind: str) -> DataFrame:
    """Poses before or after, by the gates."""
    names = [f"{a}{b}_{c}" for a in "xy" for b in "fh" for c in ("w", "loss", "good")]

    def run_costs(batches):
        for rows in batches:
            out = []
            for key, raw in zip(rows[run], rows["data"], strict=True):
                state = pickle.loads(raw)
                out.append([key, 0, state["largest"], costs(state)])
            yield pd.DataFrame(out, columns=[run, "n", "largest", "cost"])

    heads = frames.filter("cost is not null")
    sums = heads.select(run, "n", "largest", "cost")
    if between is not None:
        sums = sums.union(between.mapInPandas(run_costs, f"{run} {kind}, n long, largest long, cost array<double>"))
    per = sums.groupBy(run).agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), *[F.sum(F.col("cost")[k]).alias(c) for k, c in enumerate(names)])
    # Steps inside blocks are known; those between blocks come from their ends.
    order = Window.partitionBy(run).orderBy("block")
    gap = lambda k: F.sqrt(sum((F.col("ends")[k + x] - F.lag(F.col("ends")[k + 3 + x]).over(order)) ** 2 for x in range(3)))
    steps = frames.select(run, *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in ("s0", "s1")]).union(heads.select(run, gap(0).alias("s0"), gap(6).alias("s1"))).groupBy(run).agg(
        *[f(f"s{k}") for k in (0, 1) for f in (lambda c: F.sum(c).alias(f"sum_{c}"), lambda c: F.percentile_approx(c, 0.99, 10_000).alias(f"p99_{c}"))])
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1e-300))
    before, after = share("xf_loss", "xf_w"), share("yf_loss", "yf_w")
    gain = 1 - (after + EXACT) / (before + EXACT)
    ratio = lambda c: F.col(f"{c}_s1") / F.greatest(F.col(f"{c}_s0"), F.lit(1e-12))
    fine = (
        (F.col("xf_w") > 0) & (gain >= LEAST_GAIN) & (F.col("yh_loss") <= F.col("xh_loss") + 1e-12) & (F.col("largest") / F.col("n") >= LEAST_COVERAGE)
        & ratio("sum").between(*LENGTH_RATIO) & (ratio("p99") <= MOST_STEP_RATIO) & (share("yf_good", "yf_w") >= share("xf_good", "xf_w") - MOST_INLIER_DROP)
    )
    verdict = per.join(steps, run, "left").select(run, F.coalesce(fine, F.lit(False)).alias("accepted"), F.when(F.col("xf_w") > 0, gain).otherwise(0.0).alias("gain"))
    whole = F.concat(F.when(F.col("accepted"), F.col("new")).otherwise(F.col("old")), F.array(*[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]))
    return frames.select(run, "frame", "old", "new").join(stored(verdict, "verdict"), run).select(run, "frame", whole.alias("pose"), "accepted", "gain")


#: Frames of a stretch.
STRETCH = 4096


def relative(poses: DataFrame, gaps: tuple[int, ...], run: str = "run") -> DataFrame:
    """Edges (run, i, j, rotation, shift) between poses `gaps` frames apart, as the poses have them.

    Frames are distinct in a run. Stretches of it meet the few frames that follow them, so each pose is shuffled about once.
    """
    stretch = max(STRETCH, max(gaps))
    of = lambda c: F.floor(c / stretch)
    frame = F.col("frame").cast("long")
    dealt = poses.select(run, frame.alias("i"), F.col("pose").alias("a"), F.explode(F.array_distinct(F.array(of(frame), of(frame - max(gaps))))).alias("stretch"))
    ahead = lambda g: F.first("a").over(Window.partitionBy(run, "stretch").orderBy("i").rangeBetween(g, g))
    near = dealt.select(run, "i", "a", (of(F.col("i")) == F.col("stretch")).alias("own"), *[ahead(g).alias(f"b{g}") for g in gaps]).filter("own")
    both = near.select(run, "i", "a", F.explode(F.array(*[F.struct((F.col("i") + g).alias("j"), F.col(f"b{g}").alias("b")) for g in gaps])).alias("e")).select(run, "i", "a", "e.j", "e.b").filter("b is not null")
    # c2w: camera j from camera i is B^T A, and its shift B^T (a - b).
    e = lambda m, r, c: F.col(m)[4 * r + c]
    dot = lambda r, terms: e("b", 0, r) * terms[0] + e("b", 1, r) * terms[1] + e("b", 2, r) * terms[2]
    rotation = [dot(r, [e("a", k, c) for k in range(3)]) for r in range(3) for c in range(3)]
    shift = [dot(r, [e("a", k, 3) - e("b", k, 3) for k in range(3)]) for r in range(3)]
    return both.select(run, "i", "j", F.array(*rotation).alias("rotation"), F.array(*shift).alias("shift"))
