"""Loose numbers make their text once."""

import math

from pyspark.sql import functions as F

from pathloom.operators.predicates import number


def test_the_text_is_made_once_and_bad_ones_are_null(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(['{"v":"1.5"}', '{"v":"nan"}', '{"v":"-inf"}', '{"v":"x"}', "{}", None])], "k int, j string")
    text = F.get_json_object("j", "$.v")
    made = rows.select("k", number(text, high=1.0).alias("a"), number(text, 5.0, 2.0, 9.0).alias("b"), number(text).alias("c")).orderBy("k")
    assert [tuple(r)[1:] for r in made.collect()] == [(1.0, 2.0, 1.5), *[(None, 5.0, None)] * 5]
    plan = rows.select(number(text).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1 and not math.isnan(made.first()["c"])
