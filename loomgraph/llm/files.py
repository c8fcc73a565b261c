"""Files in the shared folder, written and read inside tasks through pyarrow's filesystems (file, hdfs, s3, gcs)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str) -> tuple[str, "object"]:
    """A new file that no other attempt of the task writes; its URI, and the stream."""
    uri = f"{folder}/{name}-{uuid.uuid4().hex}"
    where, path = of(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, where.open_output_stream(path)


def opened(uri: str):
    """The file for random access."""
    where, path = of(uri)
    return where.open_input_file(path)
