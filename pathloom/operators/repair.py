"""Repair of ordered positions: outliers, teleports, jitter. Windows only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cloud import finite
from .series import S, Series, centred_mean, clipped, gap_fill, steps


def _sum(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _dot(a: list[Column], b: list[Column]) -> Column:
    return _sum(x * y for x, y in zip(a, b, strict=True))


def _norm(a: list[Column]) -> Column:
    return F.sqrt(_dot(a, a))


def numbered(df: DataFrame, name: str, s: Series = S) -> DataFrame:
    """df with each row's place in its run, from 1."""
    return df.withColumn(name, F.row_number().over(s.ordered))


def cleaned(df: DataFrame, conf: str, axes: tuple[str, ...] = ("x", "y"), s: Series = S) -> DataFrame:
    """Positions without isolated spikes and short excursions, and a flag `outlier`.

    Invalid positions are filled in straight lines. A row is an outlier if a
    step next to it exceeds max(5 med, 2.5 p75) of its run's steps; if it turns
    back sharply, its neighbours go on at once, its steps are large and its
    confidence is weak (at most the run's p12); or if it leaves a chord of 2 to
    6 rows on either side and comes back. Outliers are filled again, and rows on
    nearly straight pieces get weights 1/4, 1/2, 1/4. Runs of fewer than three
    rows, or without motion, are only filled.
    """
    w, k = s.ordered, "row_k"
    rows = numbered(df, k, s)
    rows = rows.withColumn("row_valid", finite(*axes))
    rows = reduce(lambda d, a: gap_fill(d.withColumn(a, F.when(F.col("row_valid"), F.col(a).cast("double"))), a, k, s), axes, rows)
    move = lambda a, b: [F.lead(c, b).over(w) - F.lead(c, a).over(w) if a else F.lead(c, b).over(w) - F.col(c) for c in axes]
    back = [F.col(c) - F.lag(c).over(w) for c in axes]
    rows = rows.withColumns({"step": _norm(back), "row_after": _norm(move(0, 1)), "row_next": _norm(move(1, 2)), "row_turn": _dot(back, move(0, 1)), "row_on": _dot(move(0, 1), move(1, 2))})
    positive = F.when(F.col("step") > 1e-8, F.col("step"))
    sure = F.when(finite(conf), F.col(conf))
    stats = rows.groupBy(s.run).agg(F.count(F.lit(1)).alias("row_n"), F.percentile(positive, F.array(F.lit(0.5), F.lit(0.75))).alias("row_p"), F.when(F.count(sure) >= 5, F.percentile(sure, F.lit(0.12))).alias("row_low"))
    rows = rows.join(stats, s.run)
    med, p75, n = F.col("row_p")[0], F.col("row_p")[1], F.col("row_n")
    weak = ~finite(conf) | F.coalesce(F.col(conf) <= F.col("row_low"), F.lit(False))
    large = F.greatest("step", "row_after")
    jump = large > F.greatest(5 * med, 2.5 * p75, F.lit(1e-6))
    sharp = (F.col("step") > 1e-8) & (F.col("row_after") > 1e-8) & (F.col("row_turn") < -0.75 * F.col("step") * F.col("row_after"))
    goes_on = (F.col("row_next") > 1e-8) & (F.col("row_on") > 0.55 * F.col("row_after") * F.col("row_next"))
    flip = sharp & goes_on & weak & (large > F.greatest(2.5 * med, 1.5 * p75, F.lit(1e-6)))
    excursion = F.lit(False)
    for r in range(2, 7):
        left, right = [F.lag(c, r).over(w) for c in axes], [F.lead(c, r).over(w) for c in axes]
        chord = [b - a for a, b in zip(left, right, strict=True)]
        off = [F.col(c) - a for c, a in zip(axes, left, strict=True)]
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(off, chord) / _dot(chord, chord)))
        far = _norm([o - share * c for o, c in zip(off, chord, strict=True)])
        path = F.sum("step").over(w.rowsBetween(1 - r, r))
        returns = path > F.greatest(1.8 * _norm(chord), 2.5 * r * med)
        here = (F.least(F.lit(6), F.greatest(F.lit(2), F.floor(n / 150))) >= r) & (_dot(chord, chord) > 1e-12)
        excursion = excursion | F.coalesce(here & (far > F.greatest(4 * med, 2.2 * p75, F.lit(1e-6))) & returns & weak, F.lit(False))
    inner = (F.col(k) > 1) & (F.col(k) < n) & (n >= 3)
    rows = rows.withColumn("outlier", ~F.col("row_valid") | (inner & (F.coalesce(jump | flip, F.lit(False)) | excursion)))
    some = F.min("outlier").over(s.whole)  # false where a good row is left
    for c in axes:
        rows = gap_fill(rows.withColumn("row_c", F.when(~F.col("outlier") | some, F.col(c))), "row_c", k, s).withColumn(c, F.col("row_c")).drop("row_c")
    a, b = [F.col(c) - F.lag(c).over(w) for c in axes], [F.lead(c).over(w) - F.col(c) for c in axes]
    straight = (n >= 3) & med.isNotNull() & (_norm(a) > 1e-8) & (_norm(b) > 1e-8) & (_dot(a, b) > math.cos(math.radians(20)) * _norm(a) * _norm(b))
    smooth = {c: F.when(straight, (F.lag(c).over(w) + 2 * F.col(c) + F.lead(c).over(w)) / 4).otherwise(F.col(c)) for c in axes}
    return rows.withColumns(smooth).select(*df.columns, "outlier")


def anchored_mean(df: DataFrame, half: int, axes: tuple[str, ...] = ("x", "y"), s: Series = S) -> DataFrame:
    """Centred mean of 2 * half + 1 rows, the ends repeated, moved so that the first row stays."""
    mean = centred_mean(df, {c: f"mean_{c}" for c in axes}, half, s)
    first = lambda c: F.first(c).over(s.upto)
    return mean.select(*[c for c in df.columns if c not in axes], *[(F.col(f"mean_{c}") - first(f"mean_{c}") + first(c)).alias(c) for c in axes])


def clipped_and_smoothed(df: DataFrame, half: int = 15, s: Series = S) -> DataFrame:
    """Steps cut to max(3 med, 2 p75), then a mean of 31 rows anchored at the first."""
    cut = clipped(df, s).drop(s.x, s.y).withColumnsRenamed({"cx": s.x, "cy": s.y})
    return anchored_mean(cut, half, (s.x, s.y), s).select(*df.columns)


def teleports_held(df: DataFrame, s: Series = S) -> DataFrame:
    """Rows reached by a step above max(8 med, med + 6 MAD) take the last position before
    it, then a mean of up to nine rows (an odd number, five at least) anchored at the first.

    Runs of fewer than five rows stay as they are.
    """
    moved = steps(df, s)
    positive = F.when(F.col("step") > 1e-9, F.col("step"))
    centre = moved.groupBy(s.run).agg(F.percentile(positive, F.lit(0.5)).alias("step_med"), F.count(F.lit(1)).alias("step_n"))
    rows = moved.join(centre, s.run)
    spread = rows.groupBy(s.run).agg(F.percentile(F.when(F.col("step") > 1e-9, F.abs(F.col("step") - F.col("step_med"))), F.lit(0.5)).alias("step_mad"))
    rows = rows.join(spread, s.run)
    limit = F.greatest(8 * F.col("step_med"), F.col("step_med") + 6 * F.col("step_mad"), F.lit(1e-6))
    stays = ~F.coalesce(F.col("step") > limit, F.lit(False)) | (F.col("step_n") < 5)
    held = rows.withColumns({c: F.last(F.when(stays, F.col(c)), True).over(s.upto) for c in (s.x, s.y)})
    n = F.col("step_n")
    means = [(half, held.filter(test)) for half, test in ((4, n >= 9), (3, n.between(7, 8)), (2, n.between(5, 6)))]
    parts = [anchored_mean(part, half, (s.x, s.y), s).select(*df.columns) for half, part in means] + [held.filter(n < 5).select(*df.columns)]
    return reduce(DataFrame.unionByName, parts)


def _spread(c: str, half: int, s: Series) -> list[Column]:
    """The values of 2 * half + 1 rows around each row, the ends repeated."""
    w = s.ordered
    first, last = F.first(c).over(s.upto), F.first(c).over(Window.partitionBy(s.run).orderBy(F.desc(s.t), F.desc(s.tie)).rowsBetween(Window.unboundedPreceding, 0))
    return [F.coalesce(F.lag(c, k).over(w), first) for k in range(half, 0, -1)] + [F.col(c)] + [F.coalesce(F.lead(c, k).over(w), last) for k in range(1, half + 1)]


def stabilised(df: DataFrame, s: Series = S) -> DataFrame:
    """Runs of a hundred rows or more: median of five, then mean of nine, ends repeated and
    fixed; kept where no row moves more than max(2.5 % of the span, 15 median steps) and
    the length does not grow by over 2 %. A flag `stable` tells where it was kept."""
    w, axes = s.ordered, (s.x, s.y)
    rows = steps(numbered(df, "row_k", s), s)
    for c in axes:
        rows = rows.withColumn(f"med_{c}", F.sort_array(F.array(*_spread(c, 2, s)))[2])
    rows = rows.withColumn("row_n", F.count(F.lit(1)).over(s.whole))
    end = (F.col("row_k") == 1) | (F.col("row_k") == F.col("row_n"))
    rows = rows.withColumns({f"new_{c}": F.when(end, F.col(c)).otherwise(_sum(_spread(f"med_{c}", 4, s)) / 9) for c in axes})
    rows = rows.withColumns({"row_off": F.hypot(*[F.col(f"new_{c}") - F.col(c) for c in axes]), "row_len": F.hypot(*[F.col(f"new_{c}") - F.lag(f"new_{c}").over(w) for c in axes])})
    got = rows.groupBy(s.run).agg(
        F.hypot(*[F.max(c) - F.min(c) for c in axes]).alias("span"), F.coalesce(F.percentile(F.when(F.col("step") > 1e-12, F.col("step")), F.lit(0.5)), F.lit(0.0)).alias("med"),
        F.max("row_off").alias("off"), F.sum("row_len").alias("after"), F.sum("step").alias("before"), F.max("row_n").alias("n"),
    )
    safe = (F.col("n") >= 100) & (F.col("after") > 1e-9) & (F.col("off") <= F.greatest(0.025 * F.col("span"), 15 * F.col("med"), F.lit(1e-9))) & (F.col("after") <= 1.02 * F.col("before"))
    rows = rows.join(got.select(s.run, F.coalesce(safe, F.lit(False)).alias("stable")), s.run)
    return rows.withColumns({c: F.when(F.col("stable"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in axes}).select(*df.columns, "stable")


def trend_window(blocks: DataFrame, least: float = 0.72, s: Series = S) -> DataFrame:
    """Block positions smoothed by the widest centred mean (9, 7, 5, 3 rows, or none) that keeps
    the share `least` of the run's length, and that window."""
    axes = (s.x, s.y)
    rows = blocks
    for half in (1, 2, 3, 4):
        rows = centred_mean(rows, {c: f"w{half}_{c}" for c in axes}, half, s)
    length = lambda p: F.hypot(*[F.col(p + c) - F.lag(p + c).over(s.ordered) for c in axes])
    names = ["", *[f"w{h}_" for h in (1, 2, 3, 4)]]
    rows = rows.withColumns({f"len_{k}": length(p) for k, p in enumerate(names)})
    sums = rows.groupBy(s.run).agg(*[F.coalesce(F.sum(f"len_{k}"), F.lit(0.0)).alias(f"sum_{k}") for k in range(5)])
    half = reduce(lambda got, k: F.when(F.col(f"sum_{k}") >= least * F.col("sum_0"), k).otherwise(got), (1, 2, 3, 4), F.lit(0))
    rows = rows.join(sums.select(s.run, half.alias("half")), s.run)
    pick = lambda c: reduce(lambda got, h: F.when(F.col("half") == h, F.col(f"w{h}_{c}")).otherwise(got), (1, 2, 3, 4), F.col(c))
    return rows.withColumns({c: pick(c) for c in axes}).select(*blocks.columns, (2 * F.col("half") + 1).alias("window"))
