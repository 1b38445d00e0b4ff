"""Steps of a moving camera from two sources: fused, gated, smoothed and summed up.

What is kept from row to row is the last smoothed step and the pose, so the fold
passes runs of any length.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame

from .kernels import folded
from .series import S, Series

#: Least weight of a source; turns that damp a step, by how much; turn beside which a small step counts as none.
LEAST_WEIGHT, DAMPED, TURNING, SMALL = 0.05, ((3.0, 0.35), (6.0, 0.15)), 8.0, 0.03
#: Fixed values of the gates: turn and speed a second that don't go together, confidence below which a speed or a turn is not believed.
MOST_TURN, TURN_SPEED, FAST_SURE, TURN_SURE = 35.0, 0.20, (0.15, 0.08), (0.10, 8.0)
#: What counts as standing and as turning on the spot.
STILL, SPOT = (0.018, 0.45), (0.035, 2.0)
#: Shares of the new measurement in a smoothed step.
STEP_SHARE, TURN_SHARE, QUICK_SHARE, FLIP_SHARE, QUIET, FLIP = 0.40, 0.40, 0.85, 0.92, 0.35, 1.0
#: Turns of the two sources that contradict each other, and the lead in confidence that decides.
OPPOSED, LEAD = 1.0, 0.12


def fused(a: tuple | None, b: tuple | None) -> tuple[float, float, float, float, str]:
    """(dx, dy, turn, confidence, source) of two steps (dx, dy, turn, confidence), each of which may be missing."""
    if a is None and b is None:
        return 0.0, 0.0, 0.0, 0.0, "none"
    if a is None or b is None:
        return (*(a or b), "first" if b is None else "second")
    sure = max(a[3], b[3])
    if a[2] * b[2] < 0 and min(abs(a[2]), abs(b[2])) > OPPOSED:
        if abs(a[3] - b[3]) <= LEAD:
            return 0.0, 0.0, 0.0, 0.0, "conflict"
        return (*max(a, b, key=lambda s: s[3]), "first" if a[3] > b[3] else "second")
    u, v = max(LEAST_WEIGHT, a[3]), max(LEAST_WEIGHT, b[3])
    return (*((u * p + v * q) / (u + v) for p, q in zip(a[:3], b[:3], strict=True)), sure, "both")


def gated(dx: float, dy: float, turn: float, sure: float, dt: float) -> bool:
    """Whether a step is not believed."""
    speed, scale = math.hypot(dx, dy), max(1.0, dt)
    return (abs(turn) > MOST_TURN * scale and speed > TURN_SPEED * scale) or (sure < FAST_SURE[0] and speed > FAST_SURE[1] * scale) or (sure < TURN_SURE[0] and abs(turn) > TURN_SURE[1] * scale)


def integrated(df: DataFrame, first: tuple[str, ...] = ("dx", "dy", "turn", "conf"), second: tuple[str, ...] = ("dx2", "dy2", "turn2", "conf2"), s: Series = S) -> DataFrame:
    """Poses (run, tie, x, y, heading, source, gated, state) after each row's step.

    A source counts where none of its numbers is missing. Turns are in
    degrees, steps in the camera's own axes. Large turns damp the step; a step
    that the gates reject is none. Steps and turns are then smoothed, the turn
    quicker where the camera turns on the spot, hardly turns, or turns back.
    """

    def step(state, rows):
        out = []
        columns = [rows[c].to_numpy(float) for c in (s.t, *first, *second)]
        for key, t, *numbers in zip(rows[s.tie].to_numpy(), *columns, strict=True):
            one, two = (tuple(map(float, n)) if not any(math.isnan(v) for v in n) else None for n in (numbers[:4], numbers[4:]))
            dt = max(1e-3, t - state["t"]) if "t" in state else 1.0
            dx, dy, turn, sure, source = fused(one, two)
            speed = math.hypot(dx, dy)
            for most, share in DAMPED:
                if abs(turn) > most:
                    dx, dy = dx * share, dy * share
            if abs(turn) > TURNING and speed < SMALL:
                dx = dy = 0.0
            wrong = gated(dx, dy, turn, sure, dt)
            raw = turn
            if wrong:
                dx = dy = turn = 0.0
            speed = math.hypot(dx, dy)
            kind = "still" if speed <= STILL[0] and abs(turn) <= STILL[1] else "spot" if speed <= SPOT[0] and abs(turn) >= SPOT[1] else "moving"
            px, py, pr = state.get("last", (dx, dy, turn))
            flips = abs(pr) > FLIP and abs(raw) > FLIP and pr * raw < 0
            share = 1.0 if kind == "still" else QUICK_SHARE if kind == "spot" or abs(raw) < QUIET else FLIP_SHARE if flips else TURN_SHARE
            along = STEP_SHARE if kind == "moving" else 1.0
            dx, dy, turn = along * dx + (1 - along) * px, along * dy + (1 - along) * py, share * turn + (1 - share) * pr
            x, y, heading = state.get("pose", (0.0, 0.0, 0.0))
            a = math.radians(heading)
            x, y, heading = x + dx * math.cos(a) - dy * math.sin(a), y + dx * math.sin(a) + dy * math.cos(a), heading + turn
            state |= {"t": t, "last": (dx, dy, turn), "pose": (x, y, heading)}
            out.append((state["run"], key, x, y, 180 - (180 - heading) % 360, source, wrong, kind))
        return pd.DataFrame(out, columns=[s.run, s.tie, "x", "y", "heading", "source", "gated", "state"])

    kind = lambda c: df.schema[c].dataType.simpleString()
    return folded(df, s, dict, step, f"{s.run} {kind(s.run)}, {s.tie} {kind(s.tie)}, x double, y double, heading double, source string, gated boolean, state string")
