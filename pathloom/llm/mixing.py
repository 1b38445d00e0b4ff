"""Mixing sources to target weights: repetition rates and hash-seeded copies.

Tokens per source are aggregated first, so the only data that meet in one
place are one row per source. Targets are the capped weighted shares of the
budget (water filling in closed form over the sources ordered by cap/weight).
Each document is then emitted floor(rate) times plus one Bernoulli copy whose
coin is a hash of the seed, the identifier and the text, so reruns agree, rows
that repeat an identifier are drawn each for itself, and no state is shared
between tasks.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, fresh, text_or_empty

#: Weights by rank of the source name, repeating.
WEIGHTS = (5, 2, 1)
#: Budget as a share of all tokens, and the largest repetition of a source.
BUDGET = 1.5
CAP = 2
SEED = "mix-1"


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def coin_text(key: int | None, text: str | None) -> str:
    """What a document's coin is drawn from, beside the seed, in plain Python."""
    return f"{'null' if key is None else key}:{hashlib.md5((text or '').encode()).hexdigest()}"


def coin(key: Column, text: str = "text", seed: str = SEED) -> Column:
    """Uniform in [0, 1) from 52 bits of SHA-256 over seed, identifier and the text's MD5."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), F.md5(text_or_empty(text).cast("binary"))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources rank by code point, null last. A source whose weighted share
    exceeds cap * size stops there; the closed form finds the largest prefix
    of sources, by ascending cap/weight, that saturate. A source without
    tokens has target 0.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    caps = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * cap)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = caps.select(
        "source", "source_size", "weight", "cap",
        ((F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / F.sum("weight").over(rest)).alias("level"),
    )
    # The water level is fixed by the first source, in that order, that it does not fill; later levels are lower.
    open_level = F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(Window.partitionBy())
    return level.withColumn("open", open_level).select(
        "source", "source_size",
        F.when(F.col("open").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("open") * F.col("weight"))).alias("target"),
    )


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """docs plus size, source_size, target and copies; names avoid clashes.

    Null text has size 0; null sources form one source; only rows that repeat
    both identifier and text share a coin and are copied alike. An empty table gives
    an empty result. Returns the frame and the names of the added columns.
    """
    size, target, total, copies, src = fresh(docs, "size", "target", "source_size", "copies", "mix_source")
    sized = docs.withColumn(size, word_count(text))
    # One row per source: broadcast, as source names are few by definition (see README). The hint keeps the texts where
    # they are; Spark's own estimate of the targets is that of the texts, which it would shuffle by their few sources.
    targets = source_targets(sized.select(F.col(source).alias("s"), F.col(size).alias("n")), "s", "n", weights, budget, cap).select(F.col("source").alias(src), F.col("source_size").alias(total), F.col("target").alias(target))
    joined = sized.join(F.broadcast(targets), F.col(source).eqNullSafe(F.col(src)), "left").drop(src)
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return joined.withColumn(copies, (whole + F.when(coin(F.col(key), text, seed) < rate - whole, 1).otherwise(0)).cast("long")), {"size": size, "target": target, "source_size": total, "copies": copies}


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document repeated as often as it is taken, docs' columns only."""
    counted, names = with_copies(docs, **options)
    each, = fresh(counted, "copy")
    return counted.filter(F.col(names["copies"]) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(names["copies"])))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted, _ = with_copies(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return counted.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def oracle(docs: str = "documents") -> str:
    """DuckDB SQL with the same columns, and `copies`."""
    return rf"""
    WITH sized AS (
      SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM {docs}
    ), per AS (
      SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
    ), ranked AS (
      SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             row_number() OVER (ORDER BY source NULLS LAST) AS rank, source_size * 2 AS cap FROM per
    ), lev AS (
      SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
          / (sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM ranked
    ), opened AS (SELECT max(level) AS open FROM lev WHERE cap > level * weight
    ), targets AS (
      SELECT source, source_size, CASE WHEN open IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, open * weight) END AS target FROM lev, opened
    ), rates AS (
      SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM sized s LEFT JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ), copied AS (
      SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(sha256('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rates
    )"""


ORACLE = oracle() + "\nSELECT doc_id, size, source_size, target, size * copies AS taken FROM copied"
