"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import drop_stored, shared_dir, stored  # noqa: F401  (the operators take them from here)

#: White space of the contracts: space and 0x09-0x0D, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package when it is not installed on them.

    On a cluster pass the package with --py-files; here the repository path,
    which local workers and shared file systems can read, is enough.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def trim() -> None:
    """Give a Python worker's freed memory back, as idle workers stay beside the JVM."""
    import ctypes

    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names built from `names` that do not clash with df's own, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about most_bytes of `column` at most.

    A single longer row stays whole: one text is the unit of work.
    """
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        width = 8 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else 4
        import numpy as np

        offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if width == 8 else np.int32)[col.offset : col.offset + n + 1]
        start = 0
        while start < n:
            end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
            end = min(n, max(end, start + 1))
            yield batch.slice(start, end - start)
            start = end


#: Bits of a key filter (2 MB when all its parts are there) and of one of its parts.
FILTER_BITS, PART_BITS = 1 << 24, 1 << 15


def flagged(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """df with a boolean column: false where `key` is surely not in the one column of `keys`.

    A bitmap over hashed keys, of FILTER_BITS at most at any size, is broadcast.
    It saves the shuffle of rows that match nothing; when it is full it lets all
    rows pass, and an exact join must follow in any case.
    """
    place, part, bits, off = fresh(df, "bit_place", "bit_part", "bit_map", "bit_off")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    table = keys.select(at(keys.columns[0]).alias(place)).groupBy(F.expr(f"{place} div {PART_BITS}").alias(part)).agg(F.bitmap_construct_agg(F.expr(f"{place} % {PART_BITS}")).alias(bits))
    rows = df.withColumn(place, at(key)).withColumn(off, F.expr(f"{place} % {PART_BITS}"))
    rows = rows.withColumn(place, F.expr(f"{place} div {PART_BITS}")).join(F.broadcast(table), F.col(place) == F.col(part), "left")
    byte = f"cast(conv(hex(substring({bits}, cast({off} div 8 as int) + 1, 1)), 16, 10) as int)"
    return rows.withColumn(name, F.expr(f"coalesce(shiftright({byte}, cast({off} % 8 as int)) & 1 = 1, false)")).drop(place, part, bits, off)


#: A group above 1/HOT of all rows counts as hot; there are fewer than HOT of them.
HOT = 200


def join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """rows left-joined to one row per group, where a group may hold any share of the rows.

    Groups above total / HOT are broadcast (fewer than HOT rows); the rows they
    match are scattered in the shuffled join with the others.
    """
    extra = [c for c in groups.columns if c != on]
    hot = groups.filter(F.col(size) * HOT > total).select(F.col(on).alias("hot_on"), *[F.col(c).alias("hot_" + c) for c in extra])
    cold = groups.filter(F.col(size) * HOT <= total).withColumnRenamed(on, "cold_on")
    found = rows.join(F.broadcast(hot), F.col(on) == F.col("hot_on"), "left")
    kind = rows.schema[on].dataType
    noise = F.monotonically_increasing_id().cast("string").cast(kind) if kind.typeName() in ("string", "binary") else F.monotonically_increasing_id()
    found = found.withColumn("probe", F.when(F.col("hot_on").isNull(), F.col(on)).otherwise(noise)).withColumn("is_hot", F.col("hot_on").isNotNull())
    out = found.join(cold, (F.col("probe") == F.col("cold_on")) & ~F.col("is_hot"), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.when(F.col("is_hot"), F.col("hot_" + c)).otherwise(F.col(c)).alias(c) for c in extra])
