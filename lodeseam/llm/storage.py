"""Binary files in the shared folder, opened on executors by URI with pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """(path, open stream) of a new file. The name ends in a random part, so that a second attempt of a task never
    writes where the first one did; only files named by a finished task are read."""
    where, path = _at(folder)
    where.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex[:12]}"
    return f"{folder}/{name}", where.open_output_stream(f"{path}/{name}", buffer_size=1 << 20)


def open_at(uri: str):
    """A file to seek in."""
    where, path = _at(uri)
    return where.open_input_file(path)
