"""Centroid clustering with ball-tree filtering.

Vectors become integers, and each partition packs them into blocks of bounded
size, each with a metric tree of its own: every ball knows its middle, radius,
count and integer sum. A round sends the few centroids to all blocks. A ball
drops a centroid that the triangle inequality shows to be farther from each of
its vectors than another; a ball with one centroid left goes to it whole, by its
count and sum. The others hand their candidates down, and vectors of leaves that
are still open are compared exactly, in integers. Only counts and sums per
cluster leave a task, and they are added up by Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ship, stored

DIMENSIONS = 64
#: Integer steps per unit.
SCALE = 64
CLUSTERS, ROUNDS = 16, 3
#: Vectors of one block, and of a leaf at most.
BLOCK_ROWS, LEAF_ROWS = 4096, 24
#: Larger components are cut off here, so that squared distances stay in 64 bits.
LARGEST = 1 << 27
#: Below this, sums of squares of differences are exact in doubles.
EXACT = 1 << 20

BLOCKS = "ids array<long>, vectors binary, middles binary, radii binary, sums binary, starts binary, ends binary"


def tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A metric tree over the rows of x: their order, and by ball its middle, radius, sum, start and end.

    The children of ball b are 2b + 1 and 2b + 2. A ball is halved by rank along
    the line between its vector farthest from the middle and the one farthest
    from that. A ball without rows has an empty range.
    """
    depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / LEAF_ROWS))))
    n = (2 << depth) - 1
    order = np.arange(len(x))
    starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ends[0] = len(x)
    for b in range(n // 2):
        a, e = starts[b], ends[b]
        cut = (a + e) // 2
        if e - a > 1:
            own = x[order[a:e]].astype(float)
            one = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
            along = own @ (own[((own - one) ** 2).sum(axis=1).argmax()] - one)
            order[a:e] = order[a:e][np.argpartition(along, cut - a)]
        starts[2 * b + 1], ends[2 * b + 1], starts[2 * b + 2], ends[2 * b + 2] = a, cut, cut, e
    rows = x[order]
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(rows, axis=0)])
    sums = total[ends] - total[starts]
    middles = sums / np.maximum(ends - starts, 1)[:, None]
    radii = np.zeros(n)
    for b in range(n):
        if ends[b] > starts[b]:
            radii[b] = np.sqrt(((rows[starts[b] : ends[b]] - middles[b]) ** 2).sum(axis=1).max())
    return order, middles, radii, sums, starts, ends


def block_of(ids: list, x: np.ndarray) -> tuple:
    """One row of BLOCKS."""
    order, *parts = tree(x)
    return [ids[k] for k in order.tolist()], x[order].astype(np.int32).tobytes(), *[p.tobytes() for p in parts]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, exact."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < EXACT:
        x, c = x.astype(float), c.astype(float)
        return np.rint((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def filtered(middles: np.ndarray, radii: np.ndarray, starts: np.ndarray, ends: np.ndarray, centroids: np.ndarray) -> list[tuple[int, int, int, np.ndarray]]:
    """Ranges (ball, start, end, candidates) that cover all rows once: whole balls with one candidate, or leaves."""
    c = centroids.astype(float)
    far = np.sqrt(np.maximum((middles * middles).sum(axis=1)[:, None] - 2 * (middles @ c.T) + (c * c).sum(axis=1), 0))
    # Rounding must not drop a centroid that ties: roots of cancelled sums are off by less than this.
    slack = 1e-6 * (1 + np.sqrt((middles * middles).sum(axis=1)) + np.sqrt((c * c).sum(axis=1)).max(initial=0))
    near = far - radii[:, None] <= far.min(axis=1)[:, None] + radii[:, None] + 2 * slack[:, None]
    out, level = [], [0]
    open_ = np.zeros((len(middles), len(c)), dtype=bool)
    open_[0] = True
    while level:
        below = []
        for b in level:
            if ends[b] == starts[b]:
                continue
            left = open_[b] & near[b]
            if left.sum() == 1 or 2 * b + 1 >= len(middles):
                out.append((b, int(starts[b]), int(ends[b]), np.flatnonzero(left)))
            else:
                open_[2 * b + 1] = open_[2 * b + 2] = left
                below += [2 * b + 1, 2 * b + 2]
        level = below
    return out


def _read(row: dict, dims: int) -> tuple[np.ndarray, ...]:
    of = lambda name, kind: np.frombuffer(row[name], dtype=kind)
    return of("vectors", np.int32).reshape(-1, dims), of("middles", float).reshape(-1, dims), of("radii", float), of("sums", np.int64).reshape(-1, dims), of("starts", np.int64), of("ends", np.int64)


def steps(embedding: Column) -> Column:
    """Components as integers floor(SCALE * x), x as double, cut off at LARGEST."""
    least = lambda x: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double")))
    return F.transform(embedding, lambda x: least(x).cast("int"))


def kept(vectors: DataFrame, key: str, embedding: str, dims: int) -> DataFrame:
    """Rows (vec_id, steps) of the vectors with `dims` components, all finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = (F.size(embedding) == dims) & F.coalesce(F.forall(F.col(embedding), lambda x: finite(x.cast("double"))), F.lit(False))
    return vectors.filter(good).select(F.col(key).cast("long").alias("vec_id"), steps(F.col(embedding)).alias("steps"))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """BLOCKS of (vec_id, steps), one after another in each partition."""

    def run(batches):
        ids, held = [], []

        def packed():
            columns = zip(*[block_of(ids, np.concatenate(held))], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if k == 0 else pa.binary()) for k, c in enumerate(columns)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, BLOCK_ROWS - len(ids))
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64))
                start += part.num_rows
                if len(ids) == BLOCK_ROWS:
                    yield packed()
                    ids, held = [], []
        if ids:
            yield packed()

    return rows.mapInArrow(run, BLOCKS)


def seeds(rows: DataFrame, clusters: int, salt: str = "1") -> list[list[int]]:
    """The vectors with the smallest SHA-256 of `salt:<vec_id>`; of rows that repeat an identifier the smallest vector first."""
    digest = F.sha2(F.concat(F.lit(salt + ":"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return [list(r["steps"]) for r in rows.select(digest.alias("digest"), "steps").orderBy("digest", "steps").limit(clusters).collect()]


def sums_of(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (cluster, n, total array<long>): counts and sums of the vectors nearest to each centroid."""
    k, dims = centroids.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, middles, radii, sums, starts, ends = _read(row, dims)
                for ball, a, b, left in filtered(middles, radii, starts, ends, centroids):
                    if len(left) == 1:
                        count[left[0]] += b - a
                        total[left[0]] += sums[ball]
                    else:
                        mine = left[squares(x[a:b], centroids[left]).argmin(axis=1)]
                        count += np.bincount(mine, minlength=k)
                        np.add.at(total, mine, x[a:b])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    parts = table.drop("ids").mapInArrow(run, "cluster int, n long, total array<long>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(dims)]).alias("total"))


def assigned(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows (vec_id, cluster, distance): the nearest centroid and its squared distance."""
    dims = centroids.shape[1]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x, middles, radii, _, starts, ends = _read(row, dims)
                cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
                for _, a, b, left in filtered(middles, radii, starts, ends, centroids):
                    far = squares(x[a:b], centroids[left])
                    at = far.argmin(axis=1)
                    cluster[a:b], distance[a:b] = left[at], far[np.arange(b - a), at]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return table.select("ids", "vectors", "middles", "radii", "sums", "starts", "ends").mapInArrow(run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", dims: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance), one per kept vector, and the final centroids.

    Vectors of another length, or with a null, NaN or infinite component, are
    left out, null vectors too; components beyond 2 ** 27 steps are cut off
    there. Ties go to the smaller cluster. Rows that repeat an identifier, null
    ones included, are vectors of their own. With fewer vectors than clusters
    each starts one; an empty table gives an empty result. Other columns are
    ignored. Only the centroids and their sums pass the driver.
    """
    ship(vectors.sparkSession)
    rows = kept(vectors, key, embedding, dims)
    table = stored(blocks(rows, dims), "blocks")
    centroids = np.array(seeds(rows, clusters), np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        for r in sums_of(table, centroids).collect():  # one row per cluster
            centroids[r["cluster"]] = [t // r["n"] for t in r["total"]]
    return assigned(table, centroids), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = stored(found, "clusters")
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    # One row per cluster, CLUSTERS at most.
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(spark.createDataFrame(names, "cluster int, centroid_sha256 string")), "cluster")
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    near = lambda k: f"near{k} AS (SELECT vec_id, any_value(v.x) AS x, min(struct_pack(d := {far}, cluster := c.cluster)) AS best FROM kept v, centre{k} c GROUP BY vec_id)"
    # Integer division rounds to zero; the remainder makes it the floor.
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    parts = [
        f"kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"centre0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, x FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, x FROM kept ORDER BY h LIMIT {CLUSTERS}))",
    ]
    for k in range(ROUNDS):
        parts += [
            near(k),
            f"sums{k} AS (SELECT cluster, pos, sum(e)::BIGINT AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(x) AS e, unnest(range({DIMENSIONS})) AS pos FROM near{k}) GROUP BY cluster, pos)",
            f"centre{k + 1} AS (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM centre{k} c LEFT JOIN (SELECT cluster, list({floor} ORDER BY pos) AS x FROM sums{k} GROUP BY cluster) m USING (cluster))",
        ]
    last = near(ROUNDS)
    return f"""
WITH {", ".join(parts)}, {last}, found AS (SELECT vec_id, best.cluster AS cluster, best.d AS distance FROM near{ROUNDS})
SELECT vec_id, f.cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY f.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM found f JOIN centre{ROUNDS} c ON c.cluster = f.cluster
"""


ORACLE = _oracle()
