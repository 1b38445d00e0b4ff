"""Single files written by tasks, through the file system that their folder names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(root: str, name: str, content: bytes) -> None:
    """Write root/name, whole or not at all: a task that runs twice writes the same file once."""
    system, base = fs.FileSystem.from_uri(root)
    path = f"{base}/{name}"
    system.create_dir(path.rpartition("/")[0], recursive=True)
    half = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(half) as out:
        out.write(content)
    system.move(half, path)
