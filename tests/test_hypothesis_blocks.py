"""Samples of hypotheses meet the cells where they are, in blocks of a map's runs."""

import os

from pathloom.operators import hypotheses
from pathloom.plans import registry

SF = os.environ.get("PATHLOOM_TEST_DIR", "/root/testdata/sf0.001")


def test_samples_of_hypotheses_are_not_shuffled(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, True, 0.0)], "map long, block long, cx long, cy long, occupied boolean, clearance double")
    samples = spark.createDataFrame([(1, 0, 5, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, None)], "map long, block long, run long, dx double, dy double, sx double, sy double, turn double, base double, pace double")
    hyps = spark.createDataFrame([(1, 0, 5, 0, 0)], "map long, block long, run long, si int, yi int")
    with hypotheses._met_by_block(spark):
        plan = hypotheses.best_of(hypotheses.scored(samples, cells, hyps, 1.1, 5.0, 1.0, 1.0), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") >= 3 and "ENSURE_REQUIREMENTS" not in plan


def test_blocks_of_any_size_give_the_same_rows(spark, monkeypatch):
    whole = registry.QUERIES["hypothesis_beam"](spark, SF).collect()
    monkeypatch.setattr(hypotheses, "RUNS_A_BLOCK", 1)
    assert sorted(map(str, registry.QUERIES["hypothesis_beam"](spark, SF).collect())) == sorted(map(str, whole))
