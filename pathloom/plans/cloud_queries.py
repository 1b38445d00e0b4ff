"""Point-cloud queries over the vectors table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cloud as ops
from .bindings import CLOUD, cloud
from .catalog import query

_P = ", ".join(f"quantile_cont(conf, {q / 100}) AS p{q}" for q in ops.PERCENTS)
_GE = ", ".join(f"count(*) FILTER (WHERE conf >= {v}) AS ge_{str(v).replace('.', '_')}" for v in ops.LEVELS)
_KEPT = "kept AS (SELECT * FROM cloud WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(conf) AND conf >= 0.0 AND frame BETWEEN 2 AND 7)"


def _rounded(df, *keep, digits=6):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in keep else F.col(c) for c in df.columns])


@query("cloud_filter_conf", f"WITH {CLOUD}, {_KEPT} SELECT pid, round(x, 6) x, round(y, 6) y, round(z, 6) z, round(conf, 6) conf, frame FROM kept")
def filter_conf(spark, d):
    return _rounded(ops.filtered(cloud(spark, d), 0.0, 2, 7).select("pid", "x", "y", "z", "conf", "frame"))


@query("cloud_sanitize", f"WITH {CLOUD}, v AS (SELECT pid, CASE WHEN frame = 3 THEN 'nan'::DOUBLE WHEN frame = 4 THEN 'inf'::DOUBLE ELSE x END AS x, conf FROM cloud) SELECT pid, round(CASE WHEN isfinite(x) THEN x END, 6) AS x, round(conf, 6) AS conf FROM v")
def sanitize(spark, d):
    rows = cloud(spark, d).select("pid", F.when(F.col("frame") == 3, F.lit(float("nan"))).when(F.col("frame") == 4, F.lit(float("inf"))).otherwise(F.col("x")).alias("x"), "conf")
    return _rounded(ops.sanitized(rows))


@query("cloud_conf_percentiles", f"WITH {CLOUD}, v AS (SELECT count(conf) AS n, {_P}, {_GE} FROM cloud) SELECT n, {', '.join(f'round(p{q}, 4) AS p{q}' for q in ops.PERCENTS)}, {', '.join('ge_' + str(v).replace('.', '_') for v in ops.LEVELS)} FROM v")
def conf_percentiles(spark, d):
    return _rounded(ops.confidence_profile(cloud(spark, d)), digits=4)


@query("cloud_frame_stats", f"WITH {CLOUD}, per AS (SELECT frame, count(*) AS n FROM cloud GROUP BY frame) SELECT count(frame) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, min(n) AS min_points, max(n) AS max_points, round(avg(n), 4) AS mean_points FROM per")
def frame_stats(spark, d):
    return _rounded(ops.frame_stats(cloud(spark, d)), digits=4)


@query("cloud_frame_histogram", f"WITH {CLOUD}, per AS (SELECT frame, count(*) AS n FROM cloud GROUP BY frame), r AS (SELECT *, row_number() OVER (ORDER BY frame) AS u, row_number() OVER (ORDER BY frame DESC) AS dn, count(*) OVER () AS c FROM per) SELECT frame, n FROM r WHERE c <= 320 OR u <= 20 OR dn <= 20")
@query("cloud_frame_histogram_whole", f"WITH {CLOUD}, per AS (SELECT frame, count(*) AS n FROM cloud GROUP BY frame), r AS (SELECT *, row_number() OVER (ORDER BY frame) AS u, row_number() OVER (ORDER BY frame DESC) AS dn, count(*) OVER () AS c FROM per) SELECT frame, n FROM r WHERE c <= 320 OR u <= 20 OR dn <= 20")
def frame_histogram(spark, d):
    return ops.frame_histogram(cloud(spark, d))


@query("cloud_frame_bounds", f"WITH {CLOUD} SELECT frame, count(*) AS n, {', '.join(f'round(avg({a}), 5) AS mean_{a}, round(stddev_pop({a}), 5) AS std_{a}, round(min({a}), 5) AS min_{a}, round(max({a}), 5) AS max_{a}' for a in ops.AXES)} FROM cloud GROUP BY frame")
@query("cloud_frame_bounds_whole", f"WITH {CLOUD} SELECT frame, count(*) AS n, {', '.join(f'round(avg({a}), 5) AS mean_{a}, round(stddev_pop({a}), 5) AS std_{a}, round(min({a}), 5) AS min_{a}, round(max({a}), 5) AS max_{a}' for a in ops.AXES)} FROM cloud GROUP BY frame")
def frame_bounds(spark, d):
    return _rounded(ops.frame_bounds(cloud(spark, d)), digits=5)


@query("cloud_topk_confidence", f"WITH {CLOUD} SELECT pid, round(conf, 6) AS conf, frame FROM cloud ORDER BY cloud.conf DESC, pid LIMIT 100")
def topk(spark, d):
    return _rounded(ops.top_confidence(cloud(spark, d), 100).select("pid", "conf", "frame"))


@query("cloud_per_frame_uniform", f"WITH {CLOUD}, r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY md5('42:' || pid), pid) AS k FROM cloud) SELECT pid, frame FROM r WHERE k <= (SELECT ceil(95.0 / count(DISTINCT frame)) FROM cloud)")
def per_frame(spark, d):
    return ops.per_frame_uniform(cloud(spark, d), 95).select("pid", "frame")


@query("cloud_random_sample", f"WITH {CLOUD} SELECT pid, frame FROM cloud ORDER BY md5('42:' || pid), pid LIMIT 120")
def random_sample(spark, d):
    return ops.random_sample(cloud(spark, d), 120).select("pid", "frame")


_CELL = lambda a: f"least(7, floor(({a} - min({a}) OVER ()) / greatest(max({a}) OVER () - min({a}) OVER (), 1e-9) * 8)) AS c{a}"


@query("cloud_voxel_downsample", f"WITH {CLOUD}, c AS (SELECT pid, frame, {', '.join(_CELL(a) for a in ops.AXES)} FROM cloud) SELECT min(pid) AS pid, min_by(frame, pid) AS frame FROM c GROUP BY cx, cy, cz")
def voxel(spark, d):
    return ops.voxel_sample(cloud(spark, d), 8).select("pid", "frame")


@query("cloud_stride_sample", f"WITH {CLOUD}, r AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS pos, count(*) OVER () AS n FROM cloud) SELECT pid FROM r WHERE n <= 130 OR pos IN (SELECT floor(i * (SELECT count(*) FROM cloud) / 130)::BIGINT FROM range(130) t(i))")
def stride(spark, d):
    return ops.stride_sample(cloud(spark, d), 130).select("pid")


@query("cloud_colour", f"WITH {CLOUD}, s AS (SELECT *, CASE WHEN greatest(r, g, b) > 1 THEN 255.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM cloud) SELECT pid, {', '.join(f'round(greatest(0, least(1, {c} / k)), 6) AS {c}' for c in 'rgb')} FROM s")
def colour(spark, d):
    return _rounded(ops.colour(cloud(spark, d)).select("pid", "r", "g", "b"))


@query(
    "cloud_display_transform",
    f"""WITH {CLOUD}, m AS (SELECT pid, x - quantile_cont(x, 0.5) OVER () AS dx, y - quantile_cont(y, 0.5) OVER () AS dy, z - quantile_cont(z, 0.5) OVER () AS dz FROM cloud),
    r AS (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS radius, count(*) OVER () AS n FROM m), k AS (SELECT *, row_number() OVER (ORDER BY radius, pid) AS k FROM r),
    s AS (SELECT 18 / greatest(radius, 1e-9) AS scale FROM k WHERE k.k = floor((n - 1) * 0.95::DOUBLE) + 1)
    SELECT pid, round(dx * scale, 4) AS px, round(dz * scale, 4) AS py, round(-dy * scale, 4) AS pz FROM r, s""",
)
def display(spark, d):
    return _rounded(ops.display(cloud(spark, d)), digits=4)


@query("cloud_display_clean", f"WITH {CLOUD}, q AS (SELECT {', '.join(f'quantile_cont({a}, 0.02) AS lo{a}, quantile_cont({a}, 0.98) AS hi{a}' for a in ops.AXES)} FROM cloud) SELECT pid FROM cloud, q WHERE x BETWEEN lox AND hix AND y BETWEEN loy AND hiy AND z BETWEEN loz AND hiz")
def display_clean(spark, d):
    return ops.display_clean(cloud(spark, d)).select("pid")


@query(
    "cloud_raster",
    f"""WITH {CLOUD}, q AS (SELECT quantile_cont(x, 0.01) AS lx, quantile_cont(x, 0.99) AS hx, quantile_cont(y, 0.01) AS ly, quantile_cont(y, 0.99) AS hy FROM cloud)
    SELECT least(13, greatest(0, floor((x - lx) / greatest(hx - lx, 1e-9) * 13)))::BIGINT AS px, least(9, greatest(0, floor((y - ly) / greatest(hy - ly, 1e-9) * 9)))::BIGINT AS py, count(*) AS n FROM cloud, q GROUP BY 1, 2""",
)
def raster(spark, d):
    return ops.raster(cloud(spark, d), 14, 10)


@query(
    "cloud_unproject",
    """WITH cells AS (SELECT vec_id AS frame, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS dd FROM embeddings)
    SELECT frame, pos::BIGINT AS pos, round((pos % 8 - 4.0) * dd / 9.6 + 1.0, 5) AS x, round((pos // 8 - 4.0) * dd / 9.6 + 2.0, 5) AS y, round(dd + 3.0, 5) AS z FROM cells WHERE dd > 0.001""",
)
@query(
    "cloud_unproject_whole",
    """WITH cells AS (SELECT vec_id AS frame, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS dd FROM embeddings)
    SELECT frame, pos::BIGINT AS pos, round((pos % 8 - 4.0) * dd / 9.6 + 1.0, 5) AS x, round((pos // 8 - 4.0) * dd / 9.6 + 2.0, 5) AS y, round(dd + 3.0, 5) AS z FROM cells WHERE dd > 0.001""",
)
def unproject(spark, d):
    return _unprojected(spark.read.parquet(f"{d}/embeddings.parquet"))


def _unprojected(rows):
    depth = rows.select(F.lit("a").alias("run"), F.col("vec_id").alias("frame"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.col("embedding").cast("array<double>").alias("depth"), F.lit(None).cast("array<double>").alias("conf"))
    eye = {f"r{i}{j}": F.lit(float(i == j)) for i in range(3) for j in range(3)}
    cameras = rows.select(F.lit("a").alias("run"), F.col("vec_id").alias("frame")).withColumns(eye | {"tx": F.lit(1.0), "ty": F.lit(2.0), "tz": F.lit(3.0)} | {c: F.lit(None).cast("double") for c in ("fx", "fy", "cx", "cy")})
    return _rounded(ops.unprojected(depth, cameras).select("frame", F.col("pos").cast("long").alias("pos"), "x", "y", "z"), digits=5)
