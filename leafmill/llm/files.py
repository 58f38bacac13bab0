"""Files in the shared folder that tasks write and read themselves.

Spark has no writer for raw binary files, so tasks go through pyarrow's file systems, which
cover local, HDFS and object store addresses alike.
"""

from __future__ import annotations

import mmap
import os
from contextlib import contextmanager
from collections.abc import Iterator

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; a bare path is local."""
    if uri.startswith("file:"):
        uri = "file://" + "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


@contextmanager
def mapped(uri: str) -> Iterator[memoryview]:
    """The bytes of a file: memory-mapped where the file is local, else read."""
    system, path = opened(uri)
    if isinstance(system, pafs.LocalFileSystem):
        with open(path, "rb") as file:
            if os.fstat(file.fileno()).st_size == 0:
                yield memoryview(b"")
                return
            with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as held:
                view = memoryview(held)
                try:
                    yield view
                finally:
                    view.release()
    else:
        with system.open_input_file(path) as file:
            yield memoryview(file.read())
