"""Files of any store, opened on executors by URI."""

from __future__ import annotations

import os
from typing import BinaryIO


def _local(uri: str) -> str | None:
    """The path of a local file; the driver gives paths their scheme (``plans.shared.qualified``), so one without it is local."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def open_output(uri: str) -> BinaryIO:
    """A new file for writing; its folders are made."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    return store.open_output_stream(path)


def open_input(uri: str) -> BinaryIO:
    """A file for reading at any offset."""
    if path := _local(uri):
        return open(path, "rb", buffering=0)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
