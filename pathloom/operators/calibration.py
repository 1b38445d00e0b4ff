"""Monotone calibration of scores, and reading it.

Pool-adjacent-violators can be merged: every range of the sorted scores pools its
own rows, streaming, and a second pass pools the ranges' steps. Steps of one range
have rising means, so even ten million rows leave a few thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored
from .joins import as_of


class Pool:
    """Steps so far: weight, sum, and the scores at which the first and the last of their equal parts end."""

    def __init__(self):
        self.steps: list[list] = []

    def add(self, weight: int, total: int, first: float, last: float) -> None:
        self.steps.append([weight, total, first, last])
        while len(self.steps) > 1:
            (w0, s0, f0, _), (w1, s1, _, l1) = self.steps[-2:]
            if s0 * w1 < s1 * w0:
                break
            # Equal means stay parts of one step, whose first end remains; a violation makes one part.
            self.steps[-2:] = [[w0 + w1, s0 + s1, f0 if s0 * w1 == s1 * w0 else l1, l1]]


def isotonic(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Pool-adjacent-violators steps (group, step, first, upto, probability, n) of labels 0 and 1 by score.

    Groups with fewer than 20 usable rows, or fewer than five of a label, are
    left out, rows with another label or a score that is no finite number too. Rows
    count in order of score, then label; equal scores aren't pooled first.
    `first` is where the step's probability begins to hold, `upto` where it ends.
    """
    clean = df.select(by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and score is not null and not isnan(score) and abs(score) <> double('inf')")
    counted = stored(clean.groupBy(by, "score", "label").agg(F.count(F.lit(1)).alias("n")), "scores")
    sure = counted.groupBy(by).agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("label")).alias("ones")).filter("rows >= 20 and ones >= 5 and rows - ones >= 5")
    kind = df.schema[by].dataType.simpleString()

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pool, part = None, Pool(), 0

        def steps():
            return pd.DataFrame([(now, part, k, *s) for k, s in enumerate(pool.steps)], columns=[by, "part", "k", "n", "ones", "first", "upto"])

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else part
            for g, x, y, n in zip(batch[by], batch["score"], batch["label"], batch["n"], strict=True):
                if g != now:
                    if pool.steps:
                        yield steps()
                    now, pool = g, Pool()
                pool.add(int(n), int(n) * int(y), float(x), float(x))
        if pool.steps:
            yield steps()

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        pool = Pool()
        for n, ones, first, upto in rows.sort_values(["part", "k"])[["n", "ones", "first", "upto"]].itertuples(index=False):
            pool.add(int(n), int(ones), float(first), float(upto))
        return pd.DataFrame([(rows[by].iloc[0], k, f, u, s / n, n) for k, (n, s, f, u) in enumerate(pool.steps)], columns=[by, "step", "first", "upto", "probability", "n"])

    usable = counted.join(sure.select(by), by, "left_semi").repartitionByRange(by, "score", "label").sortWithinPartitions(by, "score", "label").withColumn("part", F.spark_partition_id())
    ranges = usable.mapInPandas(own, f"{by} {kind}, part long, k long, n long, ones long, first double, upto double")
    return ranges.groupBy(by).applyInPandas(merged, f"{by} {kind}, step long, first double, upto double, probability double, n long")


def calibrated(scores: DataFrame, steps: DataFrame, by: str, score: str, name: str = "probability") -> DataFrame:
    """scores with the probability read from the steps of their group: straight lines between
    their ends, the outer steps' beyond them, the larger where two end at one score.

    Null without a score or without steps.
    """
    ends = steps.select(by, F.explode(F.array("first", "upto")).alias(score), "probability").groupBy(by, score).agg(F.max("probability").alias(name))
    return as_of(scores, ends, by, score, name)
