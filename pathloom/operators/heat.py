"""Grid counts of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heatmap(df: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Rows in each cell and their share of the fullest cell; partial counts before the shuffle."""
    per = df.groupBy(F.floor(F.col(x) / cell).alias("gx"), F.floor(F.col(y) / cell).alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    top = per.agg(F.max("n").alias("top"))
    return per.join(F.broadcast(top)).select("gx", "gy", "n", (F.col("n") / F.col("top")).alias("intensity"))
