"""All registered queries of the movement operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import cloud_queries, geometry_queries, kernel_queries, predicate_queries, relation_queries, series_queries, source_queries, turn_queries  # noqa: F401  (they register their queries)
from .catalog import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter a point cloud and rank its most confident points."""
    return QUERIES["cloud_topk_confidence"](spark, sf_dir)
