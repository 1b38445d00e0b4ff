"""Operators whose rows depend on decisions about earlier rows of the same run.

`folded` sorts each run's rows inside its partition and carries a small state
from batch to batch, so a run of any length passes through bounded memory.
`per_run` is for the few kernels that need a whole run at once. Only the kernel
itself is Python; Spark partitions, sorts and joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import S, Series


def folded(df: DataFrame, s: Series, start: Callable[[], dict], step: Callable[[dict, pd.DataFrame], pd.DataFrame], schema: str, finish: Callable[[dict], list] | None = None) -> DataFrame:
    """Rows of step(state, rows) over each run's rows in order; a state starts anew with
    each run. finish gives a run's last rows, once all of it is seen.

    The number of tasks is given: by their bytes Spark would put many runs into one
    task, though a fold's work is in its rows. A batch's results go out together.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, state = None, None
        for batch in batches:
            keys, done = batch[s.run].to_numpy(), []
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if state is None or keys[a] != run:
                    if state is not None and finish and (rest := finish(state)):
                        yield pd.DataFrame(rest)
                    run, state = keys[a], start() | {"run": keys[a]}
                out = step(state, batch.iloc[a:b])
                if len(out):
                    done.append(out)
            if done:
                yield pd.concat(done, ignore_index=True)
        if state is not None and finish and (rest := finish(state)):
            yield pd.DataFrame(rest)

    return df.filter(F.col(s.run).isNotNull()).repartition(tasks, s.run).sortWithinPartitions(s.run, s.t, s.tie).mapInPandas(go, schema)


def per_run(df: DataFrame, s: Series, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel over each run's rows in order, one run in memory."""
    return df.groupBy(s.run).applyInPandas(lambda rows: kernel(rows.sort_values([s.t, s.tie], kind="stable").reset_index(drop=True)), schema)


def kalman(df: DataFrame, process: float = 0.05, measurement: float = 1.0, s: Series = S) -> DataFrame:
    """Constant-velocity filter of positions: (run, id, x, y, vx, vy) after each row's update.

    The axes share their gains, so a state is two means for each axis and one
    2 x 2 covariance. The first row starts at rest with covariance 1000; a step
    takes at least a millisecond, and noise grows with steps over a second.
    """

    def step(state, rows):
        out = np.empty((len(rows), 4))
        for i, (t, x, y) in enumerate(zip(rows[s.t].to_numpy(), rows[s.x].to_numpy(), rows[s.y].to_numpy(), strict=True)):
            if "mean" not in state:
                state |= {"mean": np.array([[x, y], [0.0, 0.0]]), "cov": np.eye(2) * 1000.0, "t": t}
            else:
                dt = max(1e-3, float(t - state["t"]))
                move = np.array([[1.0, dt], [0.0, 1.0]])
                mean, cov = move @ state["mean"], move @ state["cov"] @ move.T + np.eye(2) * process * max(1.0, dt)
                gain = cov[:, 0] / (cov[0, 0] + measurement)
                state["mean"] = mean + np.outer(gain, np.array([x, y]) - mean[0])
                state["cov"] = cov - np.outer(gain, cov[0])
                state["t"] = t
            out[i] = state["mean"].reshape(-1)
        return pd.DataFrame({s.run: rows[s.run].to_numpy(), s.tie: rows[s.tie].to_numpy(), "x": out[:, 0], "y": out[:, 1], "vx": out[:, 2], "vy": out[:, 3]})

    return folded(df, s, dict, step, f"{s.run} long, {s.tie} long, x double, y double, vx double, vy double")


#: Fixed values of the two-threshold turn session: mean absolute change over five rows that starts and ends it, and its least sum.
TURN_START, TURN_END, TURN_LEAST, TURN_TAIL, TURN_WARM = 0.8, 0.25, 20.0, 5, 6


def hysteresis_turns(df: DataFrame, change: str, speed: str, in_place: float = 2.0, s: Series = S) -> DataFrame:
    """Turn sessions of a change of heading: (run, middle, angle, kind, n), middle being a tie key.

    A session starts where the mean of five absolute changes reaches 0.8 (with
    motion, or one change of `in_place`) and ends where it falls to 0.25; it
    counts if its changes add up to 20 degrees.
    """

    def step(state, rows):
        found = []
        for key, d, v in zip(rows[s.tie].to_numpy(), rows[change].to_numpy(), rows[speed].to_numpy(), strict=True):
            state["n"] += 1
            state["tail"] = (state["tail"] + [(key, d, v)])[-TURN_TAIL:]
            mean = np.mean([abs(e[1]) for e in state["tail"]])
            if state["n"] < TURN_WARM:
                continue
            if state["turn"] is None:
                moves = np.mean([e[2] for e in state["tail"]]) >= 0.01 or max(abs(e[1]) for e in state["tail"]) >= in_place
                if mean >= TURN_START and moves:
                    state["turn"] = list(state["tail"])
                continue
            state["turn"].append((key, d, v))
            if mean <= TURN_END:
                turn, angle = state["turn"], sum(e[1] for e in state["turn"])
                if abs(angle) >= TURN_LEAST:
                    found.append((state["run"], turn[len(turn) // 2][0], float(angle), "left" if angle > 0 else "right", len(turn)))
                state["turn"] = None
        return pd.DataFrame(found, columns=[s.run, "middle", "angle", "kind", "n"])

    return folded(df, s, lambda: {"n": 0, "tail": [], "turn": None}, step, f"{s.run} long, middle long, angle double, kind string, n long")


def motion_states(df: DataFrame, s: Series = S, still_frames: int = 4, flow_limit: float = 0.35, move_limit: float = 0.05, turn_limit: float = 0.3, spin: float = 1.2, spin_move: float = 0.08, spin_conf: float = 0.2) -> DataFrame:
    """stationary, turn_in_place or moving for each row (run, t, id, move, turn, flow, conf, posed).

    Stillness is counted up and down: it holds from `still_frames` on and ends at
    zero. Two strong rotations without motion in sequence are a turn in place.
    """

    def step(state, rows):
        out = []
        for move, turn, flow, conf, posed in rows[["move", "turn", "flow", "conf", "posed"]].itertuples(index=False):
            turn = abs(turn)
            state["lost"] = 0 if posed else state["lost"] + 1
            calm, slow, straight = flow <= flow_limit, move <= move_limit, turn <= turn_limit
            still = straight and ((state["lost"] >= 1 and calm) or (slow and (conf < 0.06 or (conf < 0.10 and calm))))
            state["still"] = min(still_frames + 2, state["still"] + 1) if still else max(0, state["still"] - 1)
            if state["still"] >= still_frames:
                state["held"] = True
            elif state["still"] == 0:
                state["held"] = False
            spins = conf >= spin_conf and turn >= spin and move <= spin_move and not state["held"]
            state["spins"] = min(4, state["spins"] + 1) if spins else 0
            out.append("stationary" if state["held"] else "turn_in_place" if state["spins"] >= 2 else "moving")
        return pd.DataFrame({s.run: rows[s.run].to_numpy(), s.tie: rows[s.tie].to_numpy(), "state": out})

    return folded(df, s, lambda: {"lost": 0, "still": 0, "held": False, "spins": 0}, step, f"{s.run} long, {s.tie} long, state string")


def tracked(boxes: DataFrame, least: float = 0.4, most_missed: int = 8, s: Series = S) -> DataFrame:
    """Track numbers of detections (run, t, id, x1, y1, x2, y2), from 1 in each run.

    Detections of one time are taken in the order of id; each joins the track
    with the largest overlap + 1 / (1 + distance to its predicted centre) among
    those that overlap by `least`, or starts one. Velocities mix 0.7 old and 0.3
    new; a track unseen for more than `most_missed` times ends.
    """

    def step(state, rows):
        out = []
        for t, *box in rows[[s.t, "x1", "y1", "x2", "y2"]].itertuples(index=False):
            if t != state["t"]:
                live = [k for k in state["tracks"] if k["missed"] <= most_missed]
                for k in live:
                    k["missed"] += 1
                state |= {"t": t, "tracks": live}
            cx, cy = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
            best, score = None, -1.0
            for k in state["tracks"]:
                b = k["box"]
                w, h = max(0.0, min(b[2], box[2]) - max(b[0], box[0])), max(0.0, min(b[3], box[3]) - max(b[1], box[1]))
                both = (b[2] - b[0]) * (b[3] - b[1]) + (box[2] - box[0]) * (box[3] - box[1]) - w * h
                overlap = w * h / (both + 1e-6)
                if overlap >= least:
                    far = math.hypot(cx - (b[0] + b[2]) / 2 - k["v"][0], cy - (b[1] + b[3]) / 2 - k["v"][1])
                    if overlap + 1 / (1 + far) > score:
                        best, score = k, overlap + 1 / (1 + far)
            if best is None:
                best = {"id": state["next"], "v": (0.0, 0.0)}
                state["tracks"].append(best)
                state["next"] += 1
            else:
                b = best["box"]
                best["v"] = (0.7 * best["v"][0] + 0.3 * (cx - (b[0] + b[2]) / 2), 0.7 * best["v"][1] + 0.3 * (cy - (b[1] + b[3]) / 2))
            best |= {"box": box, "missed": 0}
            out.append(best["id"])
        return pd.DataFrame({s.run: rows[s.run].to_numpy(), s.tie: rows[s.tie].to_numpy(), "track": out})

    return folded(boxes, s, lambda: {"t": None, "tracks": [], "next": 1}, step, f"{s.run} long, {s.tie} long, track long")


def suppressed(boxes: DataFrame, most: float = 0.5, by: str = "frame", key: str = "id", score: str = "score") -> DataFrame:
    """Boxes (frame, id, score, x1, y1, x2, y2) without those that overlap a better kept one of their frame by more than `most`."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([score, key], ascending=[False, True])
        b = rows[["x1", "y1", "x2", "y2"]].to_numpy(float)
        area, kept = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), np.zeros(len(b), bool)
        open_ = np.arange(len(b))
        while len(open_):
            i, rest = open_[0], open_[1:]
            kept[i] = True
            side = np.maximum(0.0, np.minimum(b[i, 2:], b[rest, 2:]) - np.maximum(b[i, :2], b[rest, :2]))
            met = side[:, 0] * side[:, 1]
            open_ = rest[met / (area[i] + area[rest] - met + 1e-6) <= most]
        return rows[kept][[by, key]]

    return boxes.groupBy(by).applyInPandas(kernel, f"{by} long, {key} long")


def simplified(df: DataFrame, epsilon: float = 6.0, s: Series = S) -> DataFrame:
    """Douglas-Peucker: the rows of a run that a polyline within `epsilon` of all others needs."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[[s.x, s.y]].to_numpy(float)
        keep = np.zeros(len(p), bool)
        keep[[0, -1]] = True
        open_ = [(0, len(p) - 1)]
        while open_:
            a, b = open_.pop()
            if b - a < 2:
                continue
            chord = p[b] - p[a]
            size = float(chord @ chord)
            share = np.clip((p[a + 1 : b] - p[a]) @ chord / size, 0, 1) if size > 0 else np.zeros(b - a - 1)
            off = np.hypot(*(p[a + 1 : b] - p[a] - share[:, None] * chord).T)
            k = int(off.argmax())
            if off[k] >= epsilon:
                keep[a + 1 + k] = True
                open_ += [(a, a + 1 + k), (a + 1 + k, b)]
        return pd.DataFrame({s.run: rows[s.run][keep], "k": np.flatnonzero(keep), "x": p[keep, 0], "y": p[keep, 1]})

    return per_run(df, s, kernel, f"{s.run} long, k long, x double, y double")


def map_turns(df: DataFrame, epsilon: float = 6.0, bend: float = 12.0, least: float = 20.0, s: Series = S) -> DataFrame:
    """Turns of at least `least` degrees between the straight pieces of a simplified run.

    Vertices bent by less than `bend` against the piece so far join it; an angle
    within 12 degrees of 45, 90, 135 or 180 is snapped.
    """
    corner = Series(run=s.run, t="k", tie="k", x="x", y="y")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p, keep = rows[["x", "y"]].to_numpy(float), [0]
        turn = lambda a, b, c: math.degrees(math.remainder(math.atan2(*(p[c] - p[b])[::-1]) - math.atan2(*(p[b] - p[a])[::-1]), 2 * math.pi))
        for k in range(1, len(p) - 1):
            if abs(turn(keep[-1], k, k + 1)) > bend:
                keep.append(k)
        keep.append(len(p) - 1)
        found = []
        for a, b, c in zip(keep, keep[1:], keep[2:], strict=False):
            raw = turn(a, b, c)
            if abs(raw) >= least:
                near = min((45.0, 90.0, 135.0, 180.0), key=lambda v: abs(v - abs(raw)))
                found.append((rows[s.run][0], int(rows["k"][b]), raw, near if abs(near - abs(raw)) <= 12 else abs(raw), "left" if raw > 0 else "right"))
        return pd.DataFrame(found, columns=[s.run, "k", "raw_angle", "angle", "kind"])

    corners = simplified(df, epsilon, s)
    return corners.groupBy(s.run).applyInPandas(lambda rows: kernel(rows.sort_values("k").reset_index(drop=True)), f"{corner.run} long, k long, raw_angle double, angle double, kind string")


def regimes(df: DataFrame, boundaries: DataFrame, merge: float = 1.45, least: float = 1.55, most: float = 3.0, s: Series = S) -> DataFrame:
    """Runs rescaled piece by piece: (run, tie, x, y, factor).

    boundaries (run, k) cut a run before its k-th row (from 0), eight rows from
    its ends at least. Pieces with eight moving steps have a median speed; a
    piece within the ratio `merge` of the regime before joins it. A regime
    whose speed differs from the first one's by `least` is scaled to it, by
    `most` at most, and the steps are summed up again. Steps across a boundary
    stay. Runs under 24 rows, with fewer than 16 moving steps or without a
    boundary stay as they are.
    """
    lists = boundaries.groupBy(s.run).agg(F.sort_array(F.collect_set("k")).alias("cuts"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p, t, n = rows[[s.x, s.y]].to_numpy(float), rows[s.t].to_numpy(float), len(rows)
        out = pd.DataFrame({s.run: rows[s.run], s.tie: rows[s.tie], "x": p[:, 0], "y": p[:, 1], "factor": 1.0})
        cuts = [k for k in (rows["cuts"].iloc[0] if rows["cuts"].iloc[0] is not None else []) if 8 <= k <= n - 8]
        step, dt = np.diff(p, axis=0), np.diff(t)
        if n < 24 or not cuts:
            return out
        dt = np.where(dt > 0, dt, np.median(dt[dt > 0]) if (dt > 0).any() else 1.0)
        speed = np.hypot(*step.T) / dt
        if (speed > 1e-9).sum() < 16:
            return out
        still = max(0.05 * np.median(speed[speed > 1e-9]), 1e-9)
        ends = [0, *cuts, n]
        groups: list[list] = []  # each: pieces, moving speeds
        for a, b in zip(ends, ends[1:], strict=False):
            own = speed[a : b - 1]
            own = own[own > still]
            known = len(own) >= 8
            if groups and known and len(groups[-1][1]):
                ratio = np.median(own) / np.median(groups[-1][1])
                fits = max(ratio, 1 / ratio) <= merge
            else:
                fits = bool(groups)
            if not fits:
                groups.append([[], np.zeros(0)])
            groups[-1][0].append((a, b))
            if known:
                groups[-1][1] = np.concatenate([groups[-1][1], own])
        speeds = [np.median(g[1]) if len(g[1]) else None for g in groups]
        anchor = next((v for v in speeds if v is not None), None)
        factor = np.ones(n)
        for (pieces, _), v in zip(groups, speeds, strict=True):
            if v is not None and max(v / anchor, anchor / v) >= least:
                for a, b in pieces:
                    factor[a:b] = np.clip(anchor / v, 1 / most, most)
        inside = np.ones(n - 1, bool)
        inside[np.array(cuts) - 1] = False
        moved = step * np.where(inside, factor[:-1], 1.0)[:, None]
        out[["x", "y"]] = np.concatenate([p[:1], p[0] + np.cumsum(moved, axis=0)])
        out["factor"] = factor
        return out

    rows = df.select(s.run, s.t, s.tie, s.x, s.y).join(lists, s.run, "left")
    return per_run(rows, s, kernel, f"{s.run} long, {s.tie} long, x double, y double, factor double")


def line_fit(p: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and normal of a line by reweighted least squares (Huber at 1.5 scaled MAD)."""
    w = np.ones(len(p))
    for _ in range(rounds):
        centre = w @ p / w.sum()
        values, vectors = np.linalg.eigh((p - centre).T * w @ (p - centre))
        normal = vectors[:, 0]
        off = (p - centre) @ normal
        scale = max(1.4826 * np.median(np.abs(off - np.median(off))), 1e-9)
        w = np.minimum(1.0, 1.5 * scale / np.maximum(np.abs(off), 1e-300))
    return centre, normal


def straightened(df: DataFrame, turns: DataFrame, s: Series = S) -> DataFrame:
    """Runs with the sideways drift of surely straight pieces taken out: (run, tie, x, y, straight).

    turns (run, first, last) are places (from 0) that stay. A piece of twelve
    rows or more between them is straight if it goes at least 94 % of its length
    ahead, its directions agree (0.90, within 15 degrees) and its drift is small
    but not noise. The correction tapers to nothing at both ends.
    """
    lists = turns.groupBy(s.run).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("turns"))

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p, n = rows[[s.x, s.y]].to_numpy(float), len(rows)
        out, flags = p.copy(), np.zeros(n, bool)
        pieces, at = [], 0
        for first, last in [(max(0, int(e["first"])), min(n - 1, int(e["last"]))) for e in (rows["turns"].iloc[0] if rows["turns"].iloc[0] is not None else [])]:
            pieces.append((at, first))
            at = max(at, last)
        pieces = [(a, b) for a, b in [*pieces, (at, n - 1)] if b - a >= 11] if n >= 18 else []
        unit = max(np.median(np.hypot(*np.diff(p, axis=0).T)), 1e-9) if n > 1 else 1.0
        for a, b in pieces:
            q = p[a : b + 1]
            step = np.diff(q, axis=0)
            size = np.hypot(*step.T)
            ahead = np.hypot(*(q[-1] - q[0]))
            if size.sum() <= 10 * unit:
                continue
            centre, normal = line_fit(q)
            off = (q - centre) @ normal
            rmse = math.sqrt(np.mean(off**2))
            turned = np.unwrap(np.arctan2(step[:, 1], step[:, 0])[size > 0.08 * unit])
            if not len(turned) or ahead < 0.94 * size.sum() or abs(np.exp(1j * turned).mean()) < 0.90:
                continue
            spread = math.degrees(np.percentile(turned, 90) - np.percentile(turned, 10))
            if spread > 15 or rmse > 0.035 * max(ahead, unit) or rmse < 0.12 * unit:
                continue
            share = np.linspace(0, 1, len(q))
            edge = min(0.125, 4 / (len(q) - 1))
            blend = np.sin(np.pi / 2 * np.clip(np.minimum(share, 1 - share) / edge, 0, 1)) ** 2
            if np.abs(off * blend).max() <= max(4 * unit, 0.045 * ahead):
                out[a : b + 1] = q - (off * blend)[:, None] * normal
                flags[a : b + 1] = True
        return pd.DataFrame({s.run: rows[s.run], s.tie: rows[s.tie], "x": out[:, 0], "y": out[:, 1], "straight": flags})

    rows = df.select(s.run, s.t, s.tie, s.x, s.y).join(lists, s.run, "left")
    return per_run(rows, s, kernel, f"{s.run} long, {s.tie} long, x double, y double, straight boolean")


def anchors(df: DataFrame, unit: float, most: int, apart: float = 0.018, bend: float = 3.0, s: Series = S) -> DataFrame:
    """Rows that keep a run's shape: evenly spread by length (one for each `unit`, six at least),
    then the sharpest bends of `bend` degrees at least `apart` of the length from all others, `most` in all."""

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p, n = rows[[s.x, s.y]].to_numpy(float), len(rows)
        step = np.diff(p, axis=0)
        arc = np.concatenate([[0], np.cumsum(np.hypot(*step.T))]) if n > 1 else np.zeros(n)
        share = arc / arc[-1] if n and arc[-1] > 0 else np.linspace(0, 1, n)
        if n < 3:
            chosen = set(range(n))
        else:
            sharp = np.zeros(n)
            sharp[1:-1] = np.abs(np.diff(np.unwrap(np.arctan2(step[:, 1], step[:, 0]))))
            even = max(6, min(most, math.ceil(arc[-1] / unit) + 1))
            chosen = set(np.clip(np.searchsorted(share, np.linspace(0, 1, even)), 0, n - 1).tolist())
            for k in np.argsort(-sharp, kind="stable").tolist():
                if sharp[k] < math.radians(bend) or len(chosen) >= most:
                    break
                if min(abs(share[k] - share[c]) for c in chosen) >= apart:
                    chosen.add(k)
            inner = sorted(chosen - {0, n - 1}, key=lambda k: -sharp[k])
            chosen = {0, n - 1, *inner[: max(0, most - 2)]} if len(chosen | {0, n - 1}) > most else chosen | {0, n - 1}
        at = sorted(chosen)
        return pd.DataFrame({s.run: rows[s.run].iloc[0], "k": at, "fraction": share[at]})

    return per_run(df, s, kernel, f"{s.run} long, k long, fraction double")


def smooth_curve(n: int, at: np.ndarray, target: np.ndarray, weight: np.ndarray, stiffness: float = 80.0) -> np.ndarray:
    """The curve of n values nearest to weighted targets, with squared second differences as
    cost: a five-band system, solved by elimination from left to right in linear time."""
    band = np.zeros((3, n))  # diagonal and two above
    band[0] = 1e-6
    right = np.zeros(n)
    np.add.at(band[0], at, weight)
    np.add.at(right, at, weight * target)
    if n >= 3:
        for k, v in enumerate((1.0, -2.0, 1.0)):
            for j, u in enumerate((1.0, -2.0, 1.0)[k:]):
                band[j, k : n - 2 + k] += stiffness * v * u
    for i in range(n - 1):
        for j in (1, 2):
            if i + j < n:
                f = band[j, i] / band[0, i]
                for q in range(j, 3):
                    band[q - j, i + j] -= f * band[q, i]
                right[i + j] -= f * right[i]
    out = np.zeros(n)
    for i in range(n - 1, -1, -1):
        rest = right[i] - sum(band[j, i] * out[i + j] for j in (1, 2) if i + j < n)
        out[i] = rest / band[0, i]
    return out


def scale_curve(df: DataFrame, observed: str, weight: str, s: Series = S) -> DataFrame:
    """Runs whose steps are scaled by a smooth curve through observed heights: (run, tie, x, y, scale).

    Heights farther than 3.5 scaled MADs from the run's median (in logarithms)
    are dropped; the curve is cut to 1 / 1.8 .. 1.8, and a step takes the mean of
    its ends. A run without observations stays as it is.
    """

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        p, n = rows[[s.x, s.y]].to_numpy(float), len(rows)
        h, w = rows[observed].to_numpy(float), rows[weight].to_numpy(float)
        at = np.flatnonzero(np.isfinite(h) & (h > 1e-6) & np.isfinite(w) & (w > 0))
        log = np.log(h[at])
        off = log - np.median(log) if len(at) else log
        mad = 1.4826 * np.median(np.abs(off)) if len(at) else 0.0
        near = np.abs(off) <= 3.5 * max(mad, 1e-6)
        curve = smooth_curve(n, at[near], -off[near], w[at][near]) if near.any() else np.zeros(n)
        scale = np.exp(np.clip(curve, -math.log(1.8), math.log(1.8)))
        step = np.diff(p, axis=0) * ((scale[1:] + scale[:-1]) / 2)[:, None]
        q = np.concatenate([p[:1], p[0] + np.cumsum(step, axis=0)])
        return pd.DataFrame({s.run: rows[s.run], s.tie: rows[s.tie], "x": q[:, 0], "y": q[:, 1], "scale": scale})

    return per_run(df, s, kernel, f"{s.run} long, {s.tie} long, x double, y double, scale double")


def ordered_matches(pairs: DataFrame, events: DataFrame, by: str = "run") -> DataFrame:
    """Events (run, l, at, angle) matched in order with candidates (run, l, r, r_at, r_angle).

    Each event takes, of the candidates after the one taken before, that with
    the least 2 (if the signs differ) + distance + difference of the sizes / 180;
    an event without one has null, and its whole angle as error.
    """
    options = pairs.groupBy(by, "l").agg(F.sort_array(F.collect_list(F.struct("r_at", "r", "r_angle"))).alias("c"))
    rows = events.join(options, [by, "l"], "left")

    def kernel(rows: pd.DataFrame) -> pd.DataFrame:
        done, out = (-math.inf, -math.inf), []
        for run, key, at, angle, c in rows.sort_values(["at", "l"])[[by, "l", "at", "angle", "c"]].itertuples(index=False):
            free = [e for e in (c if c is not None else []) if (e["r_at"], e["r"]) > done]
            if not free:
                out.append((run, key, None, min(180.0, abs(angle)), True))
                continue
            best = min(free, key=lambda e: 2.0 * (np.sign(e["r_angle"]) != np.sign(angle)) + abs(e["r_at"] - at) + abs(abs(e["r_angle"]) - abs(angle)) / 180)
            done = (best["r_at"], best["r"])
            out.append((run, key, best["r"], abs((best["r_angle"] - angle + 180) % 360 - 180), bool(np.sign(best["r_angle"]) != np.sign(angle))))
        return pd.DataFrame(out, columns=[by, "l", "r", "error", "mismatch"]).astype({"r": "Int64"})

    return rows.groupBy(by).applyInPandas(kernel, f"{by} long, l long, r long, error double, mismatch boolean")
