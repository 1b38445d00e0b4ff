"""Point clouds in PLY and GLB files, one file as many tasks.

A Python data source reads the headers on the driver (a few kilobytes a file),
cuts the vertices' bytes into ranges, and each task seeks to its own. Files are
reached through Arrow's file systems (file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, id long, x double, y double, z double, r int, g int, b int, conf double"
#: Number types of PLY headers and of glTF accessors, as numpy's, little-endian.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
GLB_TYPES = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}
GLB_SIZES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
#: Names of colours and confidence in PLY headers.
NAMES = {"red": "r", "green": "g", "blue": "b", "confidence": "conf", "quality": "conf"}
RANGE_BYTES = 8 << 20
BATCH = 65_536


@dataclass
class Column:
    """Where a number of every vertex lies: byte of the first, bytes between two, type, and what a full value is (0: as it is)."""

    start: int
    stride: int
    kind: str
    full: float = 0.0


@dataclass
class Span(InputPartition):
    path: str
    first: int
    count: int
    columns: dict[str, Column] | None
    ascii_at: int = 0
    order: tuple[str, ...] = ()


def opened(path: str):
    system, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, inside


def files_of(path: str) -> list[str]:
    """The .ply and .glb files of a path: a file, or a folder with all below it, in order of their names."""
    system, inside = opened(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else path.split(inside)[0]
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith((".ply", ".glb")))


def ply_spans(path: str, source, size: int) -> Iterator[Span]:
    """Ranges of a PLY file's vertices. Elements before them must not hold lists."""
    head = b""
    while (at := head.find(b"end_header")) < 0:
        more = source.read(1 << 14)
        if not more or len(head) > 1 << 22:
            raise ValueError(f"{path}: no end of header")
        head += more
    begin = head.index(b"\n", at) + 1
    lines = [x.split() for x in head[:begin].decode("ascii", "replace").splitlines()]
    if not lines or lines[0] != ["ply"]:
        raise ValueError(f"{path}: not a PLY file")
    form = next((x[1] for x in lines if x[:1] == ["format"]), "")
    elements: list[tuple[str, int, list]] = []
    for x in lines:
        if x[:1] == ["element"]:
            elements.append((x[1], int(x[2]), []))
        elif x[:1] == ["property"] and elements:
            elements[-1][2].append(x[1:])
    skip_bytes = skip_lines = 0
    for name, count, properties in elements:
        if name == "vertex":
            break
        if any(p[0] == "list" for p in properties):
            raise ValueError(f"{path}: a list before the vertices")
        skip_bytes += count * sum(np.dtype(PLY_TYPES[p[0]]).itemsize for p in properties)
        skip_lines += count
    else:
        raise ValueError(f"{path}: no vertices")
    names = [NAMES.get(p[1], p[1]) if p[0] != "list" else "" for p in properties]
    if not {"x", "y", "z"} <= set(names) or "" in names:
        raise ValueError(f"{path}: vertices without x, y and z, or with lists")
    if form == "ascii":
        yield Span(path, skip_lines, count, None, begin, tuple(names))
        return
    if form not in ("binary_little_endian", "binary_big_endian"):
        raise ValueError(f"{path}: format {form}")
    sign, at, columns = "<" if "little" in form else ">", 0, {}
    for p, name in zip(properties, names, strict=True):
        kind = np.dtype(sign + PLY_TYPES[p[0]])
        columns[name] = Column(at, 0, kind.str, 255.0 if kind.kind == "f" and name in "rgb" else 0.0)
        at += kind.itemsize
    if begin + skip_bytes + count * at > size:
        raise ValueError(f"{path}: {count} vertices announced, the file ends before")
    for c in columns.values():
        c.start, c.stride = c.start + begin + skip_bytes, at
    yield from cut(path, count, columns, at)


def glb_spans(path: str, source, size: int) -> Iterator[Span]:
    """Ranges of the vertices of a GLB file's meshes; nodes' transforms are not applied."""
    magic, version, _ = struct.unpack("<4sII", source.read(12))
    if magic != b"glTF" or version != 2:
        raise ValueError(f"{path}: not a GLB file of version 2")
    length, kind = struct.unpack("<I4s", source.read(8))
    if kind != b"JSON":
        raise ValueError(f"{path}: its first chunk is not JSON")
    scene, base = json.loads(source.read(length)), 20 + length + 8
    first = 0

    def column(number: int, which: int, full: float = 0.0) -> tuple[Column, int]:
        accessor = scene["accessors"][number]
        view = scene["bufferViews"][accessor["bufferView"]]
        if view.get("buffer", 0) or "uri" in scene["buffers"][0]:
            raise ValueError(f"{path}: numbers outside the file")
        item = np.dtype("<" + GLB_TYPES[accessor["componentType"]])
        stride = view.get("byteStride") or item.itemsize * GLB_SIZES[accessor["type"]]
        start = base + view.get("byteOffset", 0) + accessor.get("byteOffset", 0)
        if start + max(0, accessor["count"] - 1) * stride + item.itemsize * GLB_SIZES[accessor["type"]] > size:
            raise ValueError(f"{path}: {accessor['count']} vertices announced, the file ends before")
        # Colours are parts of one in floats, parts of the largest number in whole ones.
        share = 255.0 if full and item.kind == "f" else 255.0 / np.iinfo(item).max if full and item.itemsize > 1 else 0.0
        return Column(start + which * item.itemsize, stride, item.str, share), accessor["count"]

    for mesh in scene.get("meshes", []):
        for part in mesh.get("primitives", []):
            has = part.get("attributes", {})
            if "POSITION" not in has:
                continue
            columns = {n: column(has["POSITION"], k)[0] for k, n in enumerate("xyz")}
            count = column(has["POSITION"], 0)[1]
            if "COLOR_0" in has:
                columns |= {n: column(has["COLOR_0"], k, 1.0)[0] for k, n in enumerate("rgb")}
            for span in cut(path, count, columns, max(c.stride for c in columns.values())):
                span.first += first
                for c in span.columns.values():
                    c.start -= first * c.stride
                yield span
            first += count


def cut(path: str, count: int, columns: dict[str, Column], stride: int) -> Iterator[Span]:
    step = max(1, RANGE_BYTES // stride)
    for at in range(0, count, step):
        yield Span(path, at, min(step, count - at), {n: Column(c.start, c.stride, c.kind, c.full) for n, c in columns.items()})


class MeshReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in files_of(self.path):
            system, inside = opened(path)
            size = system.get_file_info(inside).size
            with system.open_input_file(inside) as source:
                out += (ply_spans if path.lower().endswith(".ply") else glb_spans)(path, source, size)
        return out

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        if span is None:  # no file at all
            return
        system, inside = opened(span.path)
        if span.columns is None:
            with system.open_input_stream(inside) as source:
                yield from self.ascii(span, source)
            return
        with system.open_input_file(inside) as source:
            for at in range(span.first, span.first + span.count, BATCH):
                n = min(BATCH, span.first + span.count - at)
                held = {}
                for name, c in span.columns.items():
                    item = np.dtype(c.kind).itemsize
                    lo = c.start + at * c.stride
                    low = min(x.start for x in span.columns.values() if x.stride == c.stride and abs(x.start - c.start) < c.stride)
                    if (low, c.stride) not in held:
                        source.seek(low + at * c.stride)
                        held[low, c.stride] = source.read((n - 1) * c.stride + c.stride)
                    raw = np.frombuffer(held[low, c.stride], np.uint8)
                    off = lo - low - at * c.stride
                    whole = np.zeros(n * c.stride, np.uint8)
                    whole[: min(len(raw), len(whole))] = raw[: len(whole)]
                    held[name] = np.ascontiguousarray(whole.reshape(n, c.stride)[:, off : off + item]).view(c.kind)[:, 0].astype(float) * (c.full or 1.0)
                yield batch(span.path, np.arange(at, at + n), held)

    def ascii(self, span: Span, source) -> Iterator[pa.RecordBatch]:
        source.read(span.ascii_at)
        rest, skip, left, at = b"", span.first, span.count, 0
        while left:
            more = source.read(1 << 20)
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""
            lines = [x for x in lines if x.strip()]
            take, skip = lines[skip : skip + left], max(0, skip - len(lines))
            if take:
                numbers = np.array([x.split()[: len(span.order)] for x in take], dtype=float)
                left -= len(take)
                yield batch(span.path, np.arange(at, at + len(take)), dict(zip(span.order, numbers.T, strict=True)))
                at += len(take)
            if not more and left:
                raise ValueError(f"{span.path}: {span.count} vertices announced, {left} are missing")


def batch(path: str, ids: np.ndarray, numbers: dict) -> pa.RecordBatch:
    n = len(ids)
    real = lambda c: pa.array(numbers[c]) if c in numbers else pa.nulls(n, pa.float64())
    whole = lambda c: pa.array(np.rint(numbers[c]).astype(np.int32)) if c in numbers else pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(ids), real("x"), real("y"), real("z"), whole("r"), whole("g"), whole("b"), real("conf")], names=[c.split()[0] for c in SCHEMA.split(", ")])


class MeshSource(DataSource):
    """spark.read.format("mesh").load(path)"""

    @classmethod
    def name(cls) -> str:
        return "mesh"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return MeshReader(self.options)


def clouds(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (path, id, x, y, z, r, g, b, conf) of the PLY and GLB files at a path.

    Colours are 0 to 255; what a file doesn't have is null. Binary vertices are
    cut into ranges of RANGE_BYTES; an ascii file is one task, streaming. A file
    that is no such file, or ends before the vertices it announces, raises
    ValueError with its path; a folder without files gives an empty result.
    """
    spark.dataSource.register(MeshSource)
    return spark.read.format("mesh").load(path)


def cloud_file(files: list[str]) -> str | None:
    """Which of a run's files holds its cloud: PLY, then GLB, then NPZ; by name among these."""
    rank = {"ply": 0, "glb": 1, "npz": 2}
    found = sorted((rank[kind], f) for f in files if (kind := f.lower().rpartition(".")[2]) in rank)
    return found[0][1] if found else None


# -- writing


def ply_bytes(points: np.ndarray, colours: np.ndarray | None, conf: np.ndarray | None, order: str = "<") -> bytes:
    """A binary PLY file of points (n, 3) in 32-bit floats, with bytes for colours and a float for confidence."""
    fields = [(a, order + "f4") for a in "xyz"] + ([(a, "u1") for a in "rgb"] if colours is not None else []) + ([("conf", order + "f4")] if conf is not None else [])
    rows = np.zeros(len(points), dtype=fields)
    for k, a in enumerate("xyz"):
        rows[a] = points[:, k]
    for k, a in enumerate("rgb" if colours is not None else ""):
        rows[a] = colours[:, k]
    if conf is not None:
        rows["conf"] = conf
    says = {"x": "float x", "y": "float y", "z": "float z", "r": "uchar red", "g": "uchar green", "b": "uchar blue", "conf": "float confidence"}
    head = ["ply", f"format binary_{'little' if order == '<' else 'big'}_endian 1.0", f"element vertex {len(rows)}", *[f"property {says[f]}" for f, _ in fields], "end_header", ""]
    return "\n".join(head).encode() + rows.tobytes()
