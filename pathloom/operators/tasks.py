"""Task registry, stage log and selection operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Progress span in per cent and typical seconds of each stage.
STAGES = (("upload", 0.0, 6.0, 20.0), ("gpu", 6.0, 70.0, 720.0), ("trajectory", 70.0, 78.0, 25.0), ("second_observer", 78.0, 92.0, 180.0), ("map", 92.0, 99.0, 40.0))


def latest(rows: DataFrame, key: str, version: str, tie: str) -> DataFrame:
    """Upsert: the row of each key with the largest (version, tie). Partial maxima before the shuffle."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(version, tie)).alias("row")).select("row.*")


def merged_context(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Key-wise merge of maps: new keys win, a null value overwrites, absent keys keep theirs."""
    both = old.select(key, F.col(column).alias("_a")).join(new.select(key, F.col(column).alias("_b")), key, "full")
    a, b = F.coalesce("_a", F.create_map().cast("map<string,string>")), F.coalesce("_b", F.create_map().cast("map<string,string>"))
    return both.select(key, F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b).alias(column))


def batch_rank(tasks: DataFrame, seconds: int, by: str = "employee", at: str = "created_at", key: str = "id") -> DataFrame:
    """Rank and size of a task within its employee's tasks of the last `seconds`, itself included."""
    t = F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {at})")
    w = Window.partitionBy(by).orderBy("_t").rangeBetween(-seconds, 0)
    rows = tasks.withColumn("_t", t)
    return rows.select(key, by, F.count(F.lit(1)).over(w).alias("size"), F.row_number().over(Window.partitionBy(by).orderBy("_t", key)).alias("rank"))


def unread(rows: DataFrame, seen: DataFrame, key: str, by: str) -> DataFrame:
    """Rows of each owner whose key is not among the seen ones, counted."""
    return rows.join(seen.select(key).distinct(), key, "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("unread"))


def stage_durations(log: DataFrame, run: str = "run", stage: str = "kind", t: str = "t", tie: str = "id") -> DataFrame:
    """Seconds and visits of every stage: the time to the next entry of the run's log."""
    spent = F.lead(t).over(Window.partitionBy(run).orderBy(t, tie)) - F.col(t)
    return log.withColumn("_s", spent).groupBy(run, stage).agg(F.sum(F.coalesce("_s", F.lit(0.0))).alias("seconds"), F.count(F.lit(1)).alias("visits"))


def stage_progress(log: DataFrame, order: Column, run: str = "run", stages=STAGES) -> DataFrame:
    """Weighted progress that never falls: span start plus span * min(0.97, 1 - exp(-t / typical)).

    The log has stage and seconds in it; `order` sorts a run."""
    dim = log.sparkSession.createDataFrame(list(stages), "stage string, low double, high double, typical double")
    rows = log.join(F.broadcast(dim), "stage", "left")
    share = F.least(F.lit(0.97), 1 - F.exp(-F.col("seconds") / F.col("typical")))
    value = F.coalesce(F.col("low") + (F.col("high") - F.col("low")) * share, F.lit(0.0))
    return rows.withColumn("progress", F.max(value).over(Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("low", "high", "typical")


def hopping_windows(total: DataFrame, size: int, step: int) -> DataFrame:
    """Row windows [first, last) of each run's n rows that cover it completely; the last ends with it."""
    n = F.col("n")
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1)
    rows = total.filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    first = F.least(F.col("k") * step, F.greatest(F.lit(0), n - size))
    return rows.select("run", "k", first.alias("first"), F.least(n, first + size).alias("last"))


def tiered(rows: DataFrame, by: str, tier: str, accepted: str, keys: list[Column]) -> DataFrame:
    """Best accepted row of the first tier that has one, by the sort keys in turn."""
    ok = rows.filter(F.col(accepted)).withColumn("_first", F.min(tier).over(Window.partitionBy(by))).filter(F.col(tier) == F.col("_first")).drop("_first")
    return ok.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*keys))).filter("_rank = 1").drop("_rank")


def stratified_top(rows: DataFrame, strata: str, score: str, k: int, overall: int, tie: str) -> DataFrame:
    """The best k of each stratum and the best `overall` of all, without repeats."""
    per = rows.withColumn("_r", F.row_number().over(Window.partitionBy(strata).orderBy(F.desc(score), tie))).filter(F.col("_r") <= k).drop("_r")
    return per.unionByName(rows.orderBy(F.desc(score), tie).limit(overall)).dropDuplicates([tie])


def grid_best(rows: DataFrame, factors: list[float], by: str, cost) -> DataFrame:
    """Per group the factor with the least cost; cost(factor column) is an aggregate."""
    dim = rows.sparkSession.createDataFrame([(float(f),) for f in factors], "factor double")
    tried = rows.crossJoin(F.broadcast(dim)).groupBy(by, "factor").agg(cost(F.col("factor")).alias("cost"))
    return tried.groupBy(by).agg(F.min(F.struct("cost", "factor")).alias("m")).select(by, "m.factor", "m.cost")


def infer_stage(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """First stage whose keyword the lower-case text contains."""
    out = None
    for keyword, stage in rules:
        hit = F.lower(text).contains(keyword)
        out = F.when(hit, stage) if out is None else out.when(hit, stage)
    return out.otherwise(default)
