"""Floor plans as PNG masks, checked against their digests."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

#: Luminance from which a pixel belongs to a mask, and the weights of red, green and blue in 65536ths.
MARK, LUMA = 128, (19595, 38470, 7471)
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Channels by PNG's colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PLAN = "map_id string, width int, height int, metres_per_pixel double, grid_cell_pixels int, obstacle_mask_file string, obstacle_mask_sha256 string, support_mask_file string, support_mask_sha256 string"


def png_luma(raw: bytes) -> np.ndarray:
    """Luminance (height, width) of a PNG image without interlacing, 1 to 16 bits a sample; alpha is not applied."""
    if raw[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or not data:
        raise ValueError("a PNG image without data")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or colour not in CHANNELS or (colour == 3 and palette is None):
        raise ValueError("a PNG image of a kind that is not read")
    channels = CHANNELS[colour]
    step, line = max(1, channels * depth // 8), -(-width * channels * depth // 8)
    flat = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(flat) != height * (line + 1):
        raise ValueError("a PNG image that ends early")
    rows = unfiltered(flat.reshape(height, line + 1), step)
    if depth == 16:
        samples = rows.reshape(height, width * channels, 2)[:, :, 0]
    elif depth == 8:
        samples = rows
    else:
        samples = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        samples = (samples * (1 << np.arange(depth)[::-1])).sum(axis=2)[:, : width * channels]
        samples = samples * (255 // ((1 << depth) - 1)) if colour != 3 else samples
    pixels = samples[:, : width * channels].reshape(height, width, channels).astype(np.int64)
    if colour == 3:
        pixels = palette[pixels[:, :, 0]].astype(np.int64)
    return (pixels[:, :, :3] @ np.array(LUMA) + 0x8000) >> 16 if pixels.shape[2] >= 3 else pixels[:, :, 0]


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes of an image's lines, each with its filter in front; `step` bytes make a pixel."""
    out = np.zeros((len(rows), rows.shape[1] - 1), np.uint8)
    up = np.zeros(rows.shape[1] - 1, np.uint8)
    for k, row in enumerate(rows):
        kind, now = row[0], row[1:].astype(np.int64)
        if kind == 1:
            for c in range(step):
                now[c::step] = np.cumsum(now[c::step])
        elif kind == 2:
            now = now + up
        elif kind in (3, 4):
            above = up.astype(np.int64).tolist()
            line = now.tolist()
            for i in range(len(line)):
                a, b = line[i - step] if i >= step else 0, above[i]
                if kind == 3:
                    line[i] = line[i] + (a + b) // 2 & 255
                else:
                    c = above[i - step] if i >= step else 0
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    line[i] = line[i] + (a if p <= q and p <= r else b if q <= r else c) & 255
            now = np.array(line)
        elif kind:
            raise ValueError("a PNG line with an unknown filter")
        up = out[k] = (now & 255).astype(np.uint8)
    return out


def png_bytes(luma: np.ndarray) -> bytes:
    """A grey PNG image of 8 bits."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((len(luma), 1), np.uint8), luma.astype(np.uint8)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", luma.shape[1], luma.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


@F.arrow_udf(StructType([StructField("width", IntegerType()), StructField("marked", ArrayType(IntegerType()))]))
def mask(content: pa.Array) -> pa.Array:
    """Per PNG image its width and the numbers of its marked pixels, line by line."""
    out = []
    for raw in content:
        luma = png_luma(raw.as_py()) if raw.is_valid else None
        out.append(None if luma is None else {"width": luma.shape[1], "marked": np.flatnonzero(luma >= MARK).tolist()})
    return pa.array(out, pa.struct([("width", pa.int32()), ("marked", pa.list_(pa.int32()))]))


def plans(spark: SparkSession, root: str) -> DataFrame:
    """The plans (PLAN) that JSON files of a folder describe."""
    return spark.read.schema(PLAN).option("multiLine", True).option("pathGlobFilter", "*.json").json(root)


def plan_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Marked pixels (map_id, x, y, obstacle, support) of the plans of a folder.

    A mask whose SHA-256 is not the one its plan names raises, as one that is
    missing does; a plan without digest is not checked, without a support mask
    its pixels have support null. Pixels that neither mask marks have no row.
    """
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").option("recursiveFileLookup", True).load(root).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    named = plans(spark, root).select("map_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_mask_file").alias("file"), F.nullif(F.col(f"{k}_mask_sha256"), F.lit("")).alias("want")) for k in ("obstacle", "support")])).alias("m")).select("map_id", "m.*").filter("file is not null and file <> ''")
    held = named.join(content, "file", "left")
    wrong = F.col("content").isNull() | (F.sha2("content", 256) != F.lower("want"))
    says = F.concat(F.lit("mask of another digest, or none: "), "map_id", F.lit(" "), "kind")
    checked = held.withColumn("content", F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(says).cast("binary")).otherwise(F.col("content")))
    marked = checked.select("map_id", "kind", mask("content").alias("m")).select("map_id", "kind", "m.width", F.explode("m.marked").alias("p"))
    has = named.groupBy("map_id").agg(F.bool_or(F.col("kind") == "support").alias("both"))
    cells = marked.groupBy("map_id", (F.col("p") % F.col("width")).alias("x"), F.expr("p div width").cast("int").alias("y")).agg(F.bool_or(F.col("kind") == "obstacle").alias("obstacle"), F.bool_or(F.col("kind") == "support").alias("support"))
    return cells.join(has, "map_id").select("map_id", "x", "y", "obstacle", F.when(F.col("both"), F.col("support")).alias("support"))


def plan_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells (map_id, cx, cy, occupied) of grid_cell_pixels each: occupied where any pixel is an obstacle."""
    size = plans(spark, root).select("map_id", F.coalesce("grid_cell_pixels", F.lit(4)).alias("size"), "width", "height")
    hit = plan_pixels(spark, root).filter("obstacle").join(size.select("map_id", "size"), "map_id").select("map_id", F.expr("x div size").alias("cx"), F.expr("y div size").alias("cy")).distinct().withColumn("occupied", F.lit(True))
    grid = size.select("map_id", "size", "height", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(width - 1) div size"))).alias("cx")).select("map_id", "cx", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(height - 1) div size"))).alias("cy"))
    return grid.join(hit, ["map_id", "cx", "cy"], "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))
