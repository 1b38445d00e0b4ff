"""Global positions and percentiles without a single-partition window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def with_position(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """df and each row's position, from 0, in a total order.

    Rows are range-partitioned and sorted; positions inside a partition are
    local, and a prefix sum over the partitions' sizes (one row for each)
    makes them global.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    table = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_local": local}), "ranked")
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return table.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def percentiles(df: DataFrame, value: Column | str, shares: list[float], name: str = "p") -> DataFrame:
    """One row with the exact linear percentiles of all values, as an array.

    Equal values are counted before the shuffle; the counts are range-partitioned
    and a prefix sum over the partitions (one row for each) tells which few
    partitions hold the wanted positions. Nulls are ignored; without a value the
    array holds nulls.
    """
    column = F.col(value) if isinstance(value, str) else value
    counted = df.select(column.cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    table = stored(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()), "counts")
    sizes = table.groupBy("part").agg(F.sum("n").alias("m"))
    total = sizes.agg(F.sum("m")).first()[0] or 0
    at = [q * (total - 1) for q in shares]
    wanted = sorted({f(a) for a in at for f in (math.floor, math.ceil)}) if total else [-1]
    before = sizes.select("part", "m", (F.sum("m").over(Window.orderBy("part")) - F.col("m")).alias("before"))
    hit = before.filter(F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("m"))))
    run = F.sum("n").over(Window.partitionBy("part").orderBy("v")) + F.col("before")
    ends = table.join(F.broadcast(hit), "part").select("v", run.alias("upto"), (run - F.col("n")).alias("from"))
    pick = {w: F.max(F.when((F.col("from") <= w) & (w < F.col("upto")), F.col("v"))) for w in wanted}
    linear = [pick[math.floor(a)] * (1 - (a - math.floor(a))) + pick[math.ceil(a)] * (a - math.floor(a)) if total else F.lit(None).cast("double") for a in at]
    return ends.agg(F.array(*linear).alias(name))


def grouped_percentiles(df: DataFrame, by: str, value: Column | str, shares: list[float], name: str = "p") -> DataFrame:
    """Rows (by, name): the exact linear percentiles of each group's values, as an array.

    As `percentiles`: counted values are range-partitioned by group and value, so
    a group may span many tasks; the prefix sums run over one row for each group
    and partition. Nulls are ignored; a group without values has no row.
    """
    column = F.col(value) if isinstance(value, str) else value
    counted = df.select(F.col(by).alias("g"), column.cast("double").alias("v")).filter("v is not null").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    table = stored(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "counts")
    sizes = table.groupBy("g", "part").agg(F.sum("n").alias("m"))
    whole = Window.partitionBy("g")
    before = sizes.select("g", "part", "m", (F.sum("m").over(whole.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(whole).alias("total"))
    places = [F.lit(q) * (F.col("total") - 1) for q in shares]
    ends = [f(p) for p in places for f in (F.floor, F.ceil)]
    hit = before.filter(F.exists(F.array(*ends), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("m"))))
    run = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v")) + F.col("before")
    rows = table.join(hit, ["g", "part"]).select("g", "v", "total", run.alias("upto"), (run - F.col("n")).alias("from"))
    pick = lambda at: F.max(F.when((F.col("from") <= at) & (at < F.col("upto")), F.col("v")))
    part = [F.max(p - F.floor(p)) for p in places]
    linear = [pick(F.floor(p)) * (1 - s) + pick(F.ceil(p)) * s for p, s in zip(places, part, strict=True)]
    return rows.groupBy("g").agg(F.array(*linear).alias(name)).withColumnRenamed("g", by)
