"""Correspondence joins: equi, as-of, interpolating, nearest and k-nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that one task of a window over whole runs holds, about.
ROWS_A_TASK = 100_000


def dealt(df: DataFrame, by: str) -> DataFrame:
    """df dealt by `by` to a number of tasks that grows with its rows.

    Windows that follow keep this partitioning, so a task's sorts and buffers
    stay as large as they are however many rows there are; with the session's
    fixed number of partitions they would grow with the table.
    """
    fewest = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(fewest, -(-df.count() // ROWS_A_TASK)), by)


def merged(df: DataFrame) -> DataFrame:
    """df for a join by sorting on both sides, never by broadcast.

    Spark's size estimate does not count the rows that an explode adds, so it
    would take a table of any size for small and send it through the driver.
    """
    return df.hint("merge")


def overlap_merge(left: DataFrame, right: DataFrame, on: str, conf: str) -> DataFrame:
    """Rows of left, with the larger confidence where right has the key, then the
    rows of right whose key left lacks."""
    both = left.join(right.select(F.col(on), F.col(conf).alias("_other")).groupBy(on).agg(F.max("_other").alias("_other")), on, "left")
    kept = both.withColumn(conf, F.greatest(conf, "_other")).drop("_other").select(*left.columns)
    return kept.unionByName(right.join(left.select(on).distinct(), on, "left_anti").select(*left.columns))


def as_of(left: DataFrame, right: DataFrame, by: str, t: str, value: str, nearest: bool = False, parts: int | None = None) -> DataFrame:
    """left with right's value interpolated at left's time, by group.

    Both sides are united; the neighbours before and after are carried by two
    running windows, one for each direction, so no pairs are made and the work
    is linear in a group's rows. Outside right's span the nearest
    end is held; without right rows the value is null. With `nearest` the closer
    neighbour is taken, the earlier one on a tie. `parts` tasks share the groups.
    """
    names = left.columns
    rows = left.select(*names, F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_left")).unionByName(
        right.select(F.col(by), F.col(t), F.col(value).cast("double").alias("_v"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    if parts:
        rows = rows.repartition(parts, by)
    known = F.when(F.col("_left") == 0, F.col(t))
    before = Window.partitionBy(by).orderBy(t, "_left").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(F.desc(t), "_left").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_a": F.last("_v", True).over(before), "_ta": F.last(known, True).over(before), "_b": F.last("_v", True).over(after), "_tb": F.last(known, True).over(after)}).filter("_left = 1")
    gap = F.col("_tb") - F.col("_ta")
    if nearest:
        out = F.when(F.col("_tb").isNull() | (F.col(t) - F.col("_ta") <= F.col("_tb") - F.col(t)), F.col("_a")).otherwise(F.col("_b"))
    else:
        out = F.col("_a") + (F.col("_b") - F.col("_a")) * F.when(gap > 0, (F.col(t) - F.col("_ta")) / gap).otherwise(0.0)
    return rows.select(*names, F.coalesce(out, "_a", "_b").alias(value))


def nearest_rows(left: DataFrame, right: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """left with the key and distance of right's row nearest in `at`, the smaller key on a tie."""
    names = left.columns
    rows = left.select(*names, F.lit(None).cast(right.schema[key].dataType).alias("_k"), F.lit(1).alias("_left")).unionByName(
        right.select(F.col(by), F.col(at), F.col(key).alias("_k"), F.lit(0).alias("_left")), allowMissingColumns=True
    )
    mark = F.when(F.col("_left") == 0, F.struct(F.col(at).alias("p"), F.col("_k").alias("k")))
    # Sorted so that, of equal places, the smallest key is the last in both directions.
    before = Window.partitionBy(by).orderBy(at, "_left", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(by).orderBy(F.desc(at), "_left", F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_a": F.last(mark, True).over(before), "_b": F.last(mark, True).over(after)}).filter("_left = 1")
    rank = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.p") - F.col(at)).alias("distance"), F.col(f"{c}.k").alias("k")))
    best = F.least(rank("_a"), rank("_b"))
    return rows.select(*names, best["k"].alias("nearest"), best["distance"].alias("distance"))


def neighbours(points: DataFrame, cells: DataFrame, radius: float, k: int) -> DataFrame:
    """The k nearest cells within `radius` of each point (id, x, y against cell, cx, cy).

    Both sides are bucketed by squares of the radius; a point looks in its
    square and the eight around it, so only near pairs are made.
    """
    square = lambda c: F.floor(F.col(c) / radius)
    around = F.explode(F.flatten(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.transform(F.array(*[F.lit(j) for j in (-1, 0, 1)]), lambda j: F.struct((square("x") + i).alias("bx"), (square("y") + j).alias("by"))))))
    left = points.select("id", "x", "y", around.alias("b")).select("id", "x", "y", "b.bx", "b.by")
    right = cells.select("cell", "cx", "cy", square("cx").alias("bx"), square("cy").alias("by"))
    pairs = left.join(right, ["bx", "by"]).withColumn("distance", F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))).filter(F.col("distance") <= radius)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "cell"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "cell", "rank", "distance")


def strongest_edges(edges: DataFrame, i: str, j: str, score: Column, tie: str) -> DataFrame:
    """One row for each unordered pair: i < j, the largest score, the smallest tie key.
    Partial maxima are taken before the shuffle; self pairs go."""
    pair = edges.filter(F.col(i) != F.col(j)).select(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), (F.col(i) > F.col(j)).alias("reversed"), score.alias("score"), F.col(tie).alias("tie"))
    best = F.max_by(F.struct("score", "reversed", "tie"), F.struct(F.col("score"), -F.col("tie")))
    return pair.groupBy("i", "j").agg(best.alias("b"), F.count(F.lit(1)).alias("n")).select("i", "j", "b.score", "b.reversed", F.col("b.tie").alias("tie"), "n")


def band_join(left: DataFrame, right: DataFrame, by: str, at: str, width: float) -> DataFrame:
    """Pairs (l, r) of a group whose `at` differ by at most `width`, through buckets of that width."""
    bucket = lambda c: F.floor(F.col(c) / width)
    a = left.select(F.col(by), F.col("l"), F.col(at).alias("_p"), F.explode(F.array(bucket(at) - 1, bucket(at), bucket(at) + 1)).alias("_b"))
    b = right.select(F.col(by), F.col("r"), F.col(at).alias("_q"), bucket(at).alias("_b"))
    return a.join(b, [by, "_b"]).filter(F.abs(F.col("_p") - F.col("_q")) <= width).select(by, "l", "r", (F.col("_q") - F.col("_p")).alias("offset"))


def by_precedence(sources: list[DataFrame], on: str, column: str) -> DataFrame:
    """For each key the first non-null value in the order of the sources, and its place in it."""
    ranked = None
    for k, df in enumerate(sources):
        rows = df.filter(F.col(column).isNotNull()).select(F.col(on), F.col(column), F.lit(k).alias("source"))
        ranked = rows if ranked is None else ranked.unionByName(rows)
    return ranked.groupBy(on).agg(F.min(F.struct("source", column)).alias("m")).select(on, "m.source", f"m.{column}")


def prefix_of(tasks: DataFrame, chosen: DataFrame, excluded: DataFrame) -> DataFrame:
    """For each chosen task (id): the tasks of its employee up to it, inclusive, in
    order of creation, without the excluded ones."""
    order = F.struct("created_at", "id")
    key = tasks.join(chosen.select("id").distinct(), "id", "left_semi").select("employee", F.col("id").alias("chosen"), order.alias("upto"))
    return tasks.join(key, "employee").filter(F.struct("created_at", "id") <= F.col("upto")).join(excluded.select("id").distinct(), "id", "left_anti").select("chosen", "employee", "id", "created_at")
