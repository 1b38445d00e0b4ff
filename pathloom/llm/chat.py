"""Chat formatting: collapse of cumulative snapshots, then rendering.

Logs often hold a conversation several times, each copy a few turns longer.
Every turn gets a rolling hash of the conversation up to it: the running sum of
SHA-256 words over (position, role, text). A conversation whose last hash is an
inner hash of another one is a snapshot of it and goes; of equal conversations
the smallest identifier stays. Turns are sorted into ranges once, with their
texts; from there on identifiers, positions and hashes travel, and the texts only
of conversations that stay. Positions and sums are taken within ranges first and
then over the ranges' totals, so a conversation of any length is spread over
tasks; very common conversations are merged before they are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

PART_TURNS = 256


def _word(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")


def placed(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, role, text, range, local): turns in order, in ranges of conversations and turns.

    Turns are ordered by number, role and text, nulls last; null role and text
    count as empty, and turns without a conversation form one of their own.
    Equal turns are told apart by a number of their row, so no conversation,
    turn or repeated row has to lie in one range.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("row")]
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("range"), local.alias("local")), "turns")


def rolling(table: DataFrame) -> DataFrame:
    """Rows (conv_id, range, local, pos, h1, h2) of placed turns: position from 1 and rolling hash of each.

    Only identifiers and hashes travel. Positions and sums are taken within a
    range first; what the ranges before hold of a conversation is one row for
    each of them.
    """
    light = table.select("conv_id", "range", "local", F.sha2(F.concat_ws("\x1f", "role", "text"), 256).alias("said"))
    own = Window.partitionBy("conv_id", "range")
    first = light.groupBy("conv_id", "range").agg(F.min("local").alias("first"), F.count(F.lit(1)).alias("n"))
    rows = _with_range(light, _before(first, ["n"], ["first"])).withColumn("pos", F.col("local") - F.col("first") + 1 + F.col("n_before"))
    digest = F.sha2(F.concat_ws("\x1f", F.col("pos").cast("string"), "said"), 256)
    rows = rows.withColumn("digest", digest).select("conv_id", "range", "local", "pos", _word(F.col("digest"), 1).alias("w1"), _word(F.col("digest"), 16).alias("w2"))
    running = own.orderBy("local").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy("conv_id", "range").agg(F.sum("w1").alias("w1"), F.sum("w2").alias("w2"))
    rows = rows.withColumns({"s1": F.sum("w1").over(running), "s2": F.sum("w2").over(running)}).drop("w1", "w2")
    return _with_range(rows, _before(sums, ["w1", "w2"], [])).select("conv_id", "range", "local", "pos", *[(F.col(f"s{k}") + F.col(f"w{k}_before")).cast("decimal(38,0)").alias(f"h{k}") for k in (1, 2)])


def _before(parts: DataFrame, columns: list[str], kept: list[str]) -> DataFrame:
    """Sums over a conversation's earlier ranges, one row for each range that holds some of it."""
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col("conv_id").alias("c"), F.col("range").alias("b"), *kept, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c + "_before") for c in columns])


def _with_range(rows: DataFrame, parts: DataFrame) -> DataFrame:
    return rows.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("b"))).drop("c", "b")


def maximal(hashed: DataFrame) -> DataFrame:
    """Rows (conv_id, n_turns, copies) of the conversations that stay."""
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last")).select("conv_id", "last.pos", "last.h1", "last.h2")
    whole = last.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    ends = last.select(F.col("conv_id").alias("c"), F.col("pos").alias("n"))
    inner = hashed.join(ends, F.col("conv_id").eqNullSafe(F.col("c"))).filter("pos < n").select("pos", "h1", "h2").distinct()
    return whole.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def rendered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """Rows (conv_id, part, n_turns, copies, chat): the text of each conversation that
    stays, in parts of at most part_turns turns that follow each other.

    A turn is <|role|>, a line feed, its text, <|end|> and a line feed; an
    empty role is written as unknown, and "<|" in a text as "< |". Empty
    tables give an empty result; other columns are ignored.
    """
    table = placed(turns, conv, turn, role, text)
    hashed = stored(rolling(table), "hashes")
    keep = stored(maximal(hashed), "kept").withColumnRenamed("conv_id", "keep")
    wanted = hashed.join(keep, F.col("conv_id").eqNullSafe(F.col("keep"))).select("range", "local", "pos", "n_turns", "copies")
    part = F.floor((F.col("pos") - 1) / part_turns)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|"), F.when(F.col("role") == "", "unknown").otherwise(safe(F.col("role"))), F.lit("|>\n"), safe(F.col("text")), F.lit("<|end|>\n"))
    rows = table.join(wanted, ["range", "local"]).select("conv_id", part.alias("part"), "n_turns", "copies", "pos", line.alias("line"))
    grouped = rows.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    return grouped.select("conv_id", "part", F.col("n_turns").cast("long").alias("n_turns"), "copies", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT *, sha256(string_agg(role || chr(31) || text || chr(30), '') OVER (PARTITION BY conv_id ORDER BY pos)) AS h,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t
), whole AS (
  SELECT pos AS n_turns, h, min(conv_id) AS conv_id, count(*)::BIGINT AS copies FROM p WHERE pos = n GROUP BY pos, h
), keep AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.h = w.h AND p.pos = w.n_turns AND p.pos < p.n)
)
SELECT k.conv_id, ((t.pos - 1) // 256)::BIGINT AS part, k.n_turns::BIGINT AS n_turns, k.copies,
       string_agg('<|' || CASE WHEN role = '' THEN 'unknown' ELSE replace(role, '<|', '< |') END || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY t.pos) AS chat
FROM keep k JOIN t ON t.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY ALL
"""
