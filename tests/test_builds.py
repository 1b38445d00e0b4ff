"""Raster plans, background builds, resumed builds."""

import hashlib
import json
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.sources import builds, rasters


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered_png(pixels, depth=8, colour=0, kinds=(0, 1, 2, 3, 4), palette=None):
    """A PNG whose lines take the filters in turn, written straight from their definition."""
    height, width = pixels.shape[:2]
    channels = rasters.CHANNELS[colour]
    flat = pixels.reshape(height, -1).astype(int)
    if depth == 16:
        lines = np.stack([flat >> 8, flat & 255], axis=2).reshape(height, -1)
    elif depth == 8:
        lines = flat
    else:
        bits = ((flat[:, :, None] >> np.arange(depth)[::-1]) & 1).reshape(height, -1).astype(np.uint8)
        lines = np.packbits(bits, axis=1).astype(int)
    step, out, up = max(1, channels * depth // 8), b"", [0] * lines.shape[1]
    for k, line in enumerate(lines.tolist()):
        kind = kinds[k % len(kinds)]
        coded = []
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, up[i], up[i - step] if i >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out += bytes([kind, *coded])
        up = line
    body = b"".join([chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)), chunk(b"PLTE", palette.tobytes()) if palette is not None else b"", chunk(b"tEXt", b"x"), *[chunk(b"IDAT", zlib.compress(out)[k : k + 50]) for k in range(0, len(zlib.compress(out)), 50)], chunk(b"IEND", b"")])
    return rasters.SIGNATURE + body


def test_png_images_come_back():
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (23, 17))
    assert (rasters.png_luma(rasters.png_bytes(grey)) == grey).all() and (rasters.png_luma(filtered_png(grey)) == grey).all()
    for colour, n in ((2, 3), (6, 4)):
        rgb = rng.integers(0, 256, (11, 9, n))
        luma = (rgb[:, :, 0] * 19595 + rgb[:, :, 1] * 38470 + rgb[:, :, 2] * 7471 + 0x8000) >> 16
        assert (rasters.png_luma(filtered_png(rgb, 8, colour)) == luma).all()
    two = rng.integers(0, 256, (7, 5, 2))
    assert (rasters.png_luma(filtered_png(two, 8, 4)) == two[:, :, 0]).all()
    for depth in (1, 2, 4):
        low = rng.integers(0, 1 << depth, (9, 13))
        assert (rasters.png_luma(filtered_png(low, depth)) == low * (255 // ((1 << depth) - 1))).all()
    deep = rng.integers(0, 65536, (6, 8))
    assert (rasters.png_luma(filtered_png(deep, 16)) == deep >> 8).all()
    palette = rng.integers(0, 256, (16, 3)).astype(np.uint8)
    index = rng.integers(0, 16, (8, 7))
    luma = (palette[index].astype(int) @ np.array(rasters.LUMA) + 0x8000) >> 16
    assert (rasters.png_luma(filtered_png(index, 4, 3, palette=palette)) == luma).all()
    whole = rasters.png_bytes(grey)
    for bad in (whole[:-30], b"no image", whole[:40] + b"\0" + whole[41:]):
        with pytest.raises(ValueError, match="PNG"):
            rasters.png_luma(bad)


def plan_folder(path, digest=None):
    rng = np.random.default_rng(2)
    obstacle, support = rng.integers(0, 256, (10, 14)), rng.integers(0, 256, (10, 14))
    raw = {"o.png": rasters.png_bytes(obstacle), "s.png": rasters.png_bytes(support)}
    for name, content in raw.items():
        (path / name).write_bytes(content)
    sha = lambda n: hashlib.sha256(raw[n]).hexdigest()
    (path / "a.json").write_text(json.dumps({"map_id": "a", "width": 14, "height": 10, "metres_per_pixel": 0.1, "grid_cell_pixels": 4, "obstacle_mask_file": "o.png", "obstacle_mask_sha256": digest or sha("o.png").upper(), "support_mask_file": "s.png", "support_mask_sha256": sha("s.png")}, indent=1))
    (path / "b.json").write_text(json.dumps({"map_id": "b", "width": 14, "height": 10, "obstacle_mask_file": "s.png", "obstacle_mask_sha256": ""}))
    return obstacle >= 128, support >= 128


def test_raster_plans_and_their_digests(spark, tmp_path):
    (tmp_path / "good").mkdir()
    obstacle, support = plan_folder(tmp_path / "good")
    got = {(r["map_id"], r["x"], r["y"]): (r["obstacle"], r["support"]) for r in rasters.plan_pixels(spark, str(tmp_path / "good")).collect()}
    want = {("a", x, y): (bool(obstacle[y, x]), bool(support[y, x])) for y in range(10) for x in range(14) if obstacle[y, x] or support[y, x]}
    assert got == want | {("b", x, y): (True, None) for y in range(10) for x in range(14) if support[y, x]}
    cells = {(r["map_id"], r["cx"], r["cy"]): r["occupied"] for r in rasters.plan_cells(spark, str(tmp_path / "good")).collect()}
    assert cells == {(m, x, y): bool(k[4 * y : 4 * y + 4, 4 * x : 4 * x + 4].any()) for m, k in (("a", obstacle), ("b", support)) for x in range(4) for y in range(3)}
    (tmp_path / "bad").mkdir()
    plan_folder(tmp_path / "bad", "0" * 64)
    with pytest.raises(Exception, match="mask of another digest, or none: a obstacle"):
        rasters.plan_pixels(spark, str(tmp_path / "bad")).count()
    (tmp_path / "bad" / "a.json").write_text(json.dumps({"map_id": "c", "width": 1, "height": 1, "obstacle_mask_file": "gone.png"}))
    with pytest.raises(Exception, match="c obstacle"):
        rasters.plan_pixels(spark, str(tmp_path / "bad")).count()


def test_a_cancelled_build_leaves_no_table(spark, tmp_path):
    jobs = builds.Builds(spark, f"file://{tmp_path}/builds")
    assert jobs.start("good", lambda: spark.range(100))
    assert jobs.wait("good", 60) and jobs.table("good").count() == 100

    @F.udf("long")
    def slow(x):
        time.sleep(0.2)
        return x

    jobs.start("slow", lambda: spark.range(0, 4000, 1, 4).select(slow("id").alias("id")))
    with pytest.raises(ValueError, match="being built"):
        jobs.start("slow", lambda: spark.range(1))
    time.sleep(3)
    began = time.time()
    jobs.cancel("slow")
    assert jobs.wait("slow", 60) and time.time() - began < 30
    jobs.start("bad", lambda: spark.range(3).select(F.raise_error(F.lit("no such thing"))))
    assert jobs.wait("bad", 60)
    said = {r["name"]: (r["status"], r["message"]) for r in jobs.status().collect()}
    assert said["good"][0] == "done" and said["slow"][0] == "cancelled" and said["bad"][0] == "failed" and "no such thing" in said["bad"][1]
    assert jobs.table("slow") is None and jobs.table("bad") is None and not any((tmp_path / "builds" / "data" / "slow").iterdir())
    jobs.start("slow", lambda: spark.range(7))
    assert jobs.wait("slow", 60) and jobs.table("slow").count() == 7


def test_a_resumed_build_does_only_the_rest(spark, tmp_path):
    rows = spark.range(1000).withColumn("run", F.col("id") % 40)
    made = []

    def make(own):
        made.append(1)
        return own.groupBy("run").agg(F.sum("id").alias("total"))

    root = f"file://{tmp_path}/parts"
    first = builds.resumed(rows, "run", make, root, parts=6, most=2)
    assert len(made) == 2 and 0 < first.count() < 40
    (tmp_path / "parts" / "part=3").mkdir()
    (tmp_path / "parts" / "part=3" / "part-half.parquet").write_bytes(b"broken off")
    whole = builds.resumed(rows, "run", make, root, parts=6)
    assert len(made) == 6 and {r["run"]: r["total"] for r in whole.collect()} == {k: sum(range(k, 1000, 40)) for k in range(40)}
    builds.resumed(rows, "run", make, root, parts=6)
    assert len(made) == 6
    assert builds.unfinished(rows, whole.filter("run < 10"), "run").select("run").distinct().count() == 30


def test_runs_are_recovered_from_their_frames(spark):
    frames = [(1, k) for k in range(120)] + [(2, k) for k in range(130) if k != 7] + [(3, k) for k in range(99)] + [(4, k) for k in range(200)] + [(3, 5)] * 9
    got = builds.recovered(spark.createDataFrame(frames, "run long, frame long"), spark.createDataFrame([(4,)], "run long"), "run").collect()
    assert {r["run"]: (r["frames"], r["state"]) for r in got} == {1: (120, "complete"), 2: (129, "partial"), 3: (99, "lost")}
