"""Exact deduplication through a log-structured merge index of text digests.

Each task keeps a memtable of digests; a full memtable is flushed as sorted
runs, one per digest range (shard), each with a Bloom filter. Compaction
merges at most FAN_IN runs of a shard at a time, level by level, until one run
per shard is left; every merge keeps the smallest identifier. Digests that no
other run's filter knows bypass the merge. The last runs are the index: of every
digest the identifier that stays and the number of its rows. Documents whose
digest is shared (hits) are verified byte for byte: each task keeps one text of
equal ones, so a group with a third of all rows sends one row per task, and a
digest with two different texts is regrouped by the texts themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, flagged, fresh, ship, stored, text_or_empty

MEMTABLE_ROWS = 200_000
FAN_IN = 16
ROWS_PER_SHARD = 1_000_000
BLOOM_BITS = 10
BLOOM_HASHES = 4
HOT = 200
NONE = np.iinfo(np.int64).max  # stands for a null identifier: it sorts last

RUNS = "shard int, run string, digests binary, ids binary, counts binary, ties binary, filter binary"


def normalized(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest_of(body: Column) -> Column:
    """The 32 bytes that the index knows a normalised text by."""
    return F.unhex(F.sha2(body, 256))


def _words(digests: np.ndarray) -> np.ndarray:
    """S32 digests as four big-endian words each."""
    return np.frombuffer(digests.tobytes(), dtype=">u8").reshape(-1, 4)


def bloom(digests: np.ndarray) -> np.ndarray:
    """Bloom filter bytes of sorted digests; a digest's words are its hashes."""
    bits = np.zeros(max(64, BLOOM_BITS * len(digests)) + 7 & ~7, dtype=bool)
    words = _words(digests)
    for k in range(BLOOM_HASHES):
        bits[(words[:, k] % np.uint64(len(bits))).astype(np.int64)] = True
    return np.packbits(bits)


def may_hold(packed: np.ndarray, digests: np.ndarray) -> np.ndarray:
    n = np.uint64(len(packed) * 8)
    words, found = _words(digests), np.ones(len(digests), dtype=bool)
    for k in range(BLOOM_HASHES):
        at = (words[:, k] % n).astype(np.int64)
        found &= (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return found


def merge(digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, ties: np.ndarray):
    """Sort by digest and identifier; per digest the smallest identifier, how
    many rows have it, and how many rows there are."""
    order = np.lexsort((ids, digests))
    digests, ids, counts, ties = digests[order], ids[order], counts[order], ties[order]
    first = np.ones(len(digests), dtype=bool)
    first[1:] = digests[1:] != digests[:-1]
    at = np.flatnonzero(first)
    least = ids[at]
    same = ids == np.repeat(least, np.diff(np.append(at, len(ids))))
    return digests[at], least, np.add.reduceat(counts, at), np.add.reduceat(np.where(same, ties, 0), at)


def _batch(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def _segments(run: str, shards: int, digests, ids, counts, ties):
    """One row of RUNS per shard that has digests."""
    at = ((_words(digests)[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.searchsorted(at, np.arange(shards + 1))
    rows = [(s, slice(a, b)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    for start in range(0, len(rows), 256):
        some = rows[start : start + 256]
        yield _batch({
            "shard": ([s for s, _ in some], pa.int32()), "run": ([run] * len(some), pa.string()),
            **{n: ([v[w].tobytes() for _, w in some], pa.binary()) for n, v in (("digests", digests), ("ids", ids), ("counts", counts), ("ties", ties))},
            "filter": ([bloom(digests[w]).tobytes() for _, w in some], pa.binary()),
        })


def flush_runs(digests: DataFrame, shards: int, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Sorted runs (RUNS) of a frame of digest binary and id long."""

    def flush(batches):
        from pyspark import TaskContext

        task, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0

        def out():
            d, i = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            one = np.ones(len(d), dtype=np.int64)
            yield from _segments(f"{task}.{seq}", shards, *merge(d, i, one, one))

        for b in batches:
            if b.num_rows:
                held.append((np.array(b.column(0).to_pylist(), dtype="S32"), b.column(1).fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)))
                rows += b.num_rows
            if rows >= memtable_rows:
                yield from out()
                seq, held, rows = seq + 1, [], 0
        if held:
            yield from out()

    return digests.mapInArrow(flush, RUNS)


def _load(table: pa.Table, name: str, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=dtype) for x in table.column(name).to_pylist()]


def _merged(table: pa.Table):
    runs = list(zip(*(_load(table, n, t) for n, t in (("digests", "S32"), ("ids", np.int64), ("counts", np.int64), ("ties", np.int64))), strict=True))
    filters = _load(table, "filter", np.uint8)
    alone, shared = [], []
    for k, run in enumerate(runs):
        known = np.zeros(len(run[0]), dtype=bool)
        for j, f in enumerate(filters):
            if j != k:
                known |= may_hold(f, run[0])
        alone.append([c[~known] for c in run])
        shared.append([c[known] for c in run])
    met = merge(*(np.concatenate([s[c] for s in shared]) for c in range(4)))
    whole = [np.concatenate([met[c], *(a[c] for a in alone)]) for c in range(4)]
    order = np.argsort(whole[0], kind="stable")
    return [c[order] for c in whole]


def compact(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """Levels of merges of at most about fan_in runs each; one run per shard at the end."""
    count = runs.agg(F.countDistinct("run")).first()[0]
    while count > fan_in:
        count = math.ceil(count / fan_in)

        def level(table: pa.Table) -> pa.Table:
            d, i, c, t = _merged(table)
            shard, run = table.column("shard")[0].as_py(), table.column("run")[0].as_py()
            return pa.Table.from_batches([_batch({"shard": ([shard], pa.int32()), "run": ([run], pa.string()), **{n: ([v.tobytes()], pa.binary()) for n, v in (("digests", d), ("ids", i), ("counts", c), ("ties", t), ("filter", bloom(d)))}})])

        group = F.pmod(F.xxhash64("run"), F.lit(count))
        runs = stored(runs.withColumn("run", group.cast("string")).groupBy("shard", "run").applyInArrow(level, RUNS), "runs")

    def last(table: pa.Table) -> pa.Table:
        d, i, c, t = _merged(table)
        raw = d.tobytes()
        return pa.table({"digest": pa.array([raw[k : k + 32] for k in range(0, len(raw), 32)], pa.binary()), "keep_id": pa.array(i, mask=i == NONE), "group_size": c, "ties": t})

    return runs.groupBy("shard").applyInArrow(last, "digest binary, keep_id long, group_size long, ties long")


def build_index(digests: DataFrame, total: int, memtable_rows: int = MEMTABLE_ROWS, fan_in: int = FAN_IN, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """Index rows (digest, keep_id, group_size, ties) of a frame (digest, id) of `total` rows."""
    ship(digests.sparkSession)
    shards = max(int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / rows_per_shard))
    return compact(stored(flush_runs(digests, shards, memtable_rows), "runs"), fan_in)


def _probe(rows: DataFrame, groups: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows left-joined to their group's keep_id, group_size and ties.

    A group above 1/HOT of all rows is broadcast: there are fewer than HOT of
    them. Rows they match get a scattered key for the shuffled join.
    """
    hot = groups.filter(F.col("group_size") * HOT > total).select(*on, F.col("keep_id").alias("hot_id"), F.col("group_size").alias("hot_size"), F.col("ties").alias("hot_ties"))
    cold = groups.filter(F.col("group_size") * HOT <= total).withColumnRenamed("digest", "probe")
    found = rows.join(F.broadcast(hot), on, "left")
    scattered = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("id"), F.lit(0)).cast("string"), F.monotonically_increasing_id().cast("string")), 256))
    found = found.withColumn("probe", F.when(F.col("hot_size").isNull(), F.col("digest")).otherwise(scattered))
    out = found.join(cold, ["probe", *on[1:]], "left")
    return out.select("id", "digest", *[F.coalesce(a, b).alias(b) for a, b in (("hot_id", "keep_id"), ("hot_size", "group_size"), ("hot_ties", "ties"))])


def clashes(hashed: DataFrame, shared: DataFrame) -> DataFrame:
    """Digests of `shared` that stand for two different texts of (id, body, digest).

    Rows whose digest the index holds once stay out of the shuffle.
    """
    hits = flagged(hashed, F.col("digest"), shared.select("digest"), "hit").filter("hit")
    texts = hits.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest")


def decisions(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A null identifier sorts after all others;
    keep_id is null where a whole group has none. Of rows that repeat both
    the text and the smallest identifier exactly one is kept. Empty tables
    give an empty result; other columns are ignored.
    """
    out = _decided(docs, key, text, **options)
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def _decided(docs: DataFrame, key: str, text: str, **options) -> DataFrame:
    """Rows (id, sha, keep_id, group_size, kept, tied)."""
    hashed = docs.select(F.col(f"`{key}`").cast("long").alias("id"), normalized(text).alias("body")).withColumn("digest", digest_of(F.col("body")))
    digests = stored(hashed.select("digest", "id"), "digests")
    total = digests.count()
    index = build_index(digests, total, **options)
    shared = stored(index.filter("group_size > 1"), "index")
    out = _probe(digests, shared, ["digest"], total).withColumn("sha", F.col("digest"))
    met = stored(clashes(hashed, shared), "clashes")
    if met.limit(1).count():  # the sha of the text, which no clash of the digest touches, names its group
        whole = hashed.join(met, "digest", "left_semi").select("id", F.unhex(F.sha2("body", 256)).alias("digest"), "body")
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"]
        groups = whole.groupBy("digest", "body").agg(least.alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        same = whole.groupBy("digest", "body", "id").agg(F.count(F.lit(1)).alias("ties"))
        groups = groups.join(same, ["digest", "body"]).filter(F.col("id").eqNullSafe(F.col("keep_id"))).select("digest", "keep_id", "group_size", "ties")
        again = _probe(whole.select("digest", "id"), stored(groups, "regrouped"), ["digest"], total).withColumn("sha", F.col("digest"))
        out = out.join(met, "digest", "left_anti").unionByName(again)
    single = F.col("group_size").isNull()
    out = out.withColumn("kept", single | F.col("id").eqNullSafe(F.col("keep_id"))).withColumn("keep_id", F.when(single, F.col("id")).otherwise(F.col("keep_id")))
    out = out.withColumn("tied", F.col("kept") & (F.coalesce("ties", F.lit(1)) > 1))
    if shared.filter("ties > 1").limit(1).count() or met.limit(1).count():
        tied = stored(out.filter("tied").withColumn("mark", F.monotonically_increasing_id()), "tied")
        first = tied.groupBy("sha", "id").agg(F.min("mark").alias("mark")).select("mark", F.lit(True).alias("once"))
        tied = tied.join(first, "mark", "left").withColumn("kept", F.coalesce("once", F.lit(False)))
        out = out.filter("not tied").unionByName(tied.select(*out.columns))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without its exact copies, all columns kept.

    Only rows whose identifier some dropped or repeated row has are shuffled:
    they are joined by identifier and digest. Of rows that repeat both, one
    stays. A text's row with the smallest identifier stays, null last.
    """
    decided = stored(_decided(docs, key, text, **options).select("id", "sha", "kept", "tied").filter("not kept or tied"), "dropped")
    hit, k, d = fresh(docs, "dedup_hit", "dedup_id", "dedup_digest")
    rows = flagged(docs, F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)), decided.select(F.coalesce("id", F.lit(0)).alias("id")), hit)
    pairs = decided.groupBy(F.col("id").alias("id"), F.col("sha").alias("sha")).agg(F.max("tied").alias("tied"))
    near = rows.filter(F.col(hit)).drop(hit).withColumn(k, F.col(f"`{key}`").cast("long")).withColumn(d, F.unhex(F.sha2(normalized(text), 256)))
    near = near.join(pairs.select(F.col("id").alias("pair_id"), F.col("sha").alias("pair_sha"), F.col("tied").alias("pair_tied")), F.col(k).eqNullSafe(F.col("pair_id")) & (F.col(d) == F.col("pair_sha")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    alone = near.filter("pair_sha is null").select(*columns)
    once = near.filter("pair_tied").groupBy(k, d).agg(F.first(F.struct(*columns)).alias("row")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return rows.filter(~F.col(hit)).select(*columns).unionByName(alone).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(documents(spark, sf_dir))


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), grouped AS (
  SELECT body, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM hashed GROUP BY body
)
SELECT doc_id, keep_id, group_size,
       row_number() OVER (PARTITION BY h.body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(h.body) AS text_sha256
FROM hashed h JOIN grouped g ON h.body = g.body
"""
