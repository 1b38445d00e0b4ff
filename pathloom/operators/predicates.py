"""Parsing of loose values, and compatibility, plausibility and validity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Largest and smallest speed ratio by policy.
SPEED_BOUNDS = {"authoritative": (0.30, 2.70), "independent": (0.72, 1.80), "loop_closed": (0.55, 1.80), "long_inspection": (0.04, 1.80)}
LONG_INSPECTION_SECONDS = 600.0
#: Labels of trajectory sources.
SOURCES = ("raw", "robust_candidate", "scale_aware_candidate")


def number(text: Column, default: float | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Text as a finite number within [low, high]; the default where it is none."""
    # A filtered array names the value, so that the text, which may be costly, is made once.
    value = F.get(F.filter(F.array(text.try_cast("double")), lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(0))
    value = value if default is None else F.coalesce(value, F.lit(default).cast("double"))
    value = value if low is None else F.greatest(F.lit(low), value)
    return value if high is None else F.when(value.isNotNull(), F.least(F.lit(high), value))


def json_points(text: Column) -> Column:
    """Points of a JSON array whose items are [x, y], {"x", "y"} or {"position": [x, y] or {"x", "y"}}.

    Items that are none of these, or not finite, are dropped; none is made up.
    Text that is no array gives an empty one.
    """
    at = lambda e, *paths: F.coalesce(*[number(F.get_json_object(e, p)) for p in paths])
    points = F.transform(F.from_json(text, "array<string>"), lambda e: F.struct(at(e, "$[0]", "$.x", "$.position[0]", "$.position.x").alias("x"), at(e, "$[1]", "$.y", "$.position[1]", "$.position.y").alias("y")))
    return F.coalesce(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), F.array().cast("array<struct<x:double,y:double>>"))


def json_or_empty(text: Column) -> Column:
    """A JSON object as a map of texts; an empty map where it is bad or missing."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def sampling_matches(saved: dict[str, Column], stride: Column, frames: Column, size: Column, fps: Column) -> Column:
    """Saved sampling equals the request: stride, frames and size exactly, the rate
    within 1e-9 for long sampling. A missing count is 0 and a missing rate never matches."""
    same = lambda k, want: F.coalesce(saved[k], F.lit(0)) == want
    rate = ~F.coalesce(saved["long"], F.lit(False)) | F.coalesce(F.abs(saved["fps"] - fps) <= 1e-9, F.lit(False))
    return same("stride", stride) & same("frames", frames) & same("size", size) & rate


def fragmented(components: list[Column], coverages: list[Column], connected: Column, total: Column) -> Column:
    """At least four components or a coverage below 0.45, the worst of several reports counting."""
    most = reduce(F.greatest, [F.coalesce(c, F.lit(1)) for c in components], F.lit(1))
    share = F.when(total > 0, connected / total)
    least = reduce(F.least, [F.coalesce(c, F.lit(1.0)) for c in [*coverages, share]], F.lit(1.0))
    return (most >= 4) | (least < 0.45)


def plausible_speed(ratio: Column, seconds: Column, policy: Column, loop: Column) -> Column:
    """A speed ratio within its policy's bounds; long inspections come before closed loops.

    Without a duration or a finite ratio all but independent observations pass.
    """
    inside = lambda name: ratio.between(*SPEED_BOUNDS[name])
    known = seconds.isNotNull() & ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) != float("inf"))
    own = F.when(seconds >= LONG_INSPECTION_SECONDS, inside("long_inspection")).when(loop, inside("loop_closed")).otherwise(inside("independent"))
    return F.when(~known, policy != "independent").when(policy == "independent", own).otherwise(inside("authoritative"))


def may_restore(accepted: Column, requested: Column, saved: Column, saved_requested: Column) -> Column:
    """An accepted candidate of the requested source, unless both labels are known and differ."""
    known = lambda c: F.coalesce(F.trim(c), F.lit("")).isin(*SOURCES)
    same = lambda c: F.trim(requested) == F.trim(c)
    return F.coalesce(accepted, F.lit(False)) & (~known(saved) | ~known(requested) | same(saved) | (known(saved_requested) & same(saved_requested)))


def current_run(of: Column, now: Column) -> Column:
    """The run of a record is the current one; a missing one on either side matches anything."""
    return of.isNull() | now.isNull() | (of == now)


def valid_clocks(df: DataFrame, run: str, order: str, t: str) -> DataFrame:
    """Rows of runs whose clock can be used, gaps filled in straight lines by position.

    A clock needs two values, must rise at every step and span more than 1e-9.
    """
    from .series import Series, gap_fill

    w = Window.partitionBy(run).orderBy(order)
    rows = df.withColumn("clock_at", F.row_number().over(w).cast("double"))
    known = rows.groupBy(F.col(run)).agg(F.count(t).alias("clock_known")).filter("clock_known >= 2")
    filled = gap_fill(rows.join(known, run), t, "clock_at", Series(run=run))
    moved = filled.withColumn("clock_step", F.col(t) - F.lag(t).over(w))
    fine = moved.groupBy(run).agg(F.min("clock_step").alias("clock_least"), (F.max(t) - F.min(t)).alias("clock_span")).filter("clock_least > 0 and clock_span > 1e-9")
    return filled.join(fine.select(run), run, "left_semi").select(*df.columns)


def source_choice(requested: Column, scale: dict[str, Column], robust: dict[str, Column]) -> dict[str, Column]:
    """Which pose set is used, and why not the requested one.

    scale and robust: available, accepted; robust also fresh (its graph is
    unchanged; null if that is gone) and valid.
    """
    robust_reason = (
        F.when(~robust["available"], "candidate_unavailable").when(~robust["accepted"], "candidate_rejected").when(robust["fresh"].isNull(), "source_graph_missing")
        .when(~robust["fresh"], "candidate_stale").when(~robust["valid"], "candidate_artifact_invalid")
    )
    robust_or_raw = F.when(robust_reason.isNull(), "robust_candidate").otherwise("raw")
    taken = scale["available"] & scale["accepted"]
    scaled = requested == "scale_aware_candidate"
    selected = F.when(scaled & taken, "scale_aware_candidate").when(scaled | (requested == "robust_candidate"), robust_or_raw).otherwise("raw")
    reason = (
        F.when(~requested.isin(*SOURCES), "unsupported_source").when(scaled & ~taken, F.when(scale["available"], "scale_candidate_rejected").otherwise("scale_candidate_unavailable"))
        .when(requested == "robust_candidate", robust_reason)
    )
    return {"selected": selected, "reason": reason}


def known_or_ordinal(df: DataFrame, values: DataFrame, run: str, frame: str, order: str, name: str) -> DataFrame:
    """df with values' number of its frame if that is finite, else that of its position, else NaN.

    values: run, key, value; its key is a frame or a position from 0.
    """
    rows = df.withColumn("ordinal", F.row_number().over(Window.partitionBy(run).orderBy(order)) - 1)
    by = lambda k: values.select(F.col("run").alias(run), F.col("key").alias(k), F.col("value").alias(f"{k}_value"))
    met = rows.join(by(frame), [run, frame], "left").join(by("ordinal"), [run, "ordinal"], "left")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    return met.select(*df.columns, F.coalesce(finite(f"{frame}_value"), finite("ordinal_value"), F.lit(float("nan"))).alias(name))


def at_positions(df: DataFrame, lists: DataFrame, run: str, position: str, names: dict[str, str]) -> DataFrame:
    """df with the items of lists' arrays at its position (from 0); null outside."""
    return df.join(lists, run, "left").select(*df.columns, *[F.when((F.col(position) >= 0) & (F.col(position) < F.size(c)), F.try_element_at(c, F.col(position).cast("int") + 1)).alias(new) for c, new in names.items()])


def first_key(text: Column, *keys: str) -> Column:
    """The first of several keys of a JSON object that holds a number."""
    return F.coalesce(*[number(F.get_json_object(text, f"$.{k}")) for k in keys])


def linspace_rows(df: DataFrame, run: str, position: str, count: int, available: Column, back: int) -> DataFrame:
    """`count` evenly spread positions of each run (half to even), each replaced by
    the last available one within `back` positions before it; none there drops it."""
    n = df.groupBy(run).agg((F.max(position) + 1).alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.least(F.lit(count), F.col("n")).cast("int") - 1)).alias("k")
    steps = F.greatest(F.lit(1), F.least(F.lit(count), F.col("n")) - 1)
    wanted = n.select(run, "n", k).withColumn("want", F.bround(F.col("k") * (F.col("n") - 1) / steps, 0).cast("long"))
    have = df.select(run, F.col(position).cast("long").alias("have"), available.alias("ok")).filter("ok").drop("ok")
    reach = wanted.withColumn("have", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("want") - back), F.col("want"))))
    return reach.join(have, [run, "have"], "left_semi").groupBy(run, "k", "want").agg(F.max("have").alias("taken"))
