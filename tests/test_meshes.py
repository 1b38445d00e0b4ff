"""PLY and GLB files: byte orders, ascii, truncated files, many ranges."""

import json
import struct

import numpy as np
import pytest

from pathloom.sources import meshes


def cloud(n, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 3)).astype(np.float32), rng.integers(0, 256, (n, 3)).astype(np.uint8), rng.random(n).astype(np.float32)


def rows_of(spark, path):
    return sorted((r["path"].rpartition("/")[2], r["id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["conf"]) for r in meshes.clouds(spark, str(path)).collect())


def expected(name, p, c=None, f=None):
    return [(name, k, *map(float, p[k]), *(map(int, c[k]) if c is not None else (None,) * 3), float(f[k]) if f is not None else None) for k in range(len(p))]


def glb(parts, interleaved=False):
    body, views, accessors, primitives = b"", [], [], []
    for p, c in parts:
        attributes = {"POSITION": len(accessors)}
        if interleaved:
            mixed = np.zeros(len(p), dtype=[("p", "<f4", 3), ("c", "u1", 4)])
            mixed["p"], mixed["c"][:, :3] = p, c
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": mixed.nbytes, "byteStride": 16})
            accessors += [{"bufferView": len(views) - 1, "componentType": 5126, "count": len(p), "type": "VEC3"}, {"bufferView": len(views) - 1, "byteOffset": 12, "componentType": 5121, "normalized": True, "count": len(p), "type": "VEC4"}]
            attributes["COLOR_0"] = len(accessors) - 1
            body += mixed.tobytes()
        else:
            views.append({"buffer": 0, "byteOffset": len(body), "byteLength": p.nbytes})
            accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "count": len(p), "type": "VEC3"})
            body += p.tobytes()
            if c is not None:
                share = (c / np.float32(255)).astype(np.float32)
                views.append({"buffer": 0, "byteOffset": len(body), "byteLength": share.nbytes})
                accessors.append({"bufferView": len(views) - 1, "componentType": 5126, "count": len(p), "type": "VEC3"})
                attributes["COLOR_0"] = len(accessors) - 1
                body += share.tobytes()
        primitives.append({"attributes": attributes, "mode": 0})
    scene = json.dumps({"asset": {"version": "2.0"}, "buffers": [{"byteLength": len(body)}], "bufferViews": views, "accessors": accessors, "meshes": [{"primitives": primitives}]}).encode()
    scene += b" " * (-len(scene) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(scene) + len(body)) + struct.pack("<I4s", len(scene), b"JSON") + scene + struct.pack("<I4s", len(body), b"BIN\0") + body


@pytest.mark.parametrize("ranges", [8 << 20, 500])
def test_files_come_back(spark, tmp_path, monkeypatch, ranges):
    monkeypatch.setattr(meshes, "RANGE_BYTES", ranges)
    p, c, f = cloud(700)
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.ply").write_bytes(meshes.ply_bytes(p, c, f))
    (tmp_path / "b.PLY").write_bytes(meshes.ply_bytes(p, None, None, ">") + b"more bytes")
    text = "ply\nformat ascii 1.0\ncomment two extra elements\nelement note 2\nproperty int k\nelement vertex 700\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n1\n2\n"
    (tmp_path / "sub" / "c.ply").write_text(text + "\n".join(" ".join([*map(repr, map(float, a)), *map(str, b)]) for a, b in zip(p, c, strict=True)) + "\n3 0 1 2\n")
    q, d, _ = cloud(90, 2)
    (tmp_path / "d.glb").write_bytes(glb([(p, c), (q, d)]))
    (tmp_path / "e.glb").write_bytes(glb([(q, d)], interleaved=True))
    (tmp_path / "f.glb").write_bytes(glb([(q, None)]))
    (tmp_path / "g.ply").write_bytes(meshes.ply_bytes(p[:0], None, None))
    (tmp_path / "note.txt").write_text("no cloud")
    want = expected("a.ply", p, c, f) + expected("b.PLY", p) + expected("c.ply", p, c) + expected("d.glb", np.concatenate([p, q]), np.concatenate([c, d])) + expected("e.glb", q, d) + expected("f.glb", q)
    assert rows_of(spark, tmp_path) == sorted(want, key=lambda r: r[:2])
    assert rows_of(spark, f"file://{tmp_path}/a.ply") == expected("a.ply", p, c, f)


@pytest.mark.parametrize("name,raw,says", [
    ("a.ply", meshes.ply_bytes(cloud(50)[0], None, None)[:-5], "ends before"),
    ("b.ply", b"plx\nend_header\n", "not a PLY"),
    ("c.ply", b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n", "missing"),
    ("d.ply", b"ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nend_header\n1\n2\n3\n", "x, y and z"),
    ("e.glb", glb([(cloud(50)[0], None)])[:-7], "ends before"),
    ("f.glb", b"glTX" + bytes(40), "not a GLB"),
])
def test_damaged_files_raise(spark, tmp_path, name, raw, says):
    (tmp_path / name).write_bytes(raw)
    with pytest.raises(Exception, match=says):
        meshes.clouds(spark, str(tmp_path)).count()


def test_an_empty_folder_and_the_order_of_discovery(spark, tmp_path):
    assert meshes.clouds(spark, str(tmp_path)).count() == 0
    assert meshes.cloud_file(["z.npz", "b.GLB", "a.glb", "y.ply", "x.PLY"]) == "x.PLY" and meshes.cloud_file(["z.npz", "b.GLB"]) == "b.GLB" and meshes.cloud_file(["a.txt"]) is None
