"""File systems that tasks write to, by URI."""

from __future__ import annotations

import importlib
import os

from pyarrow import fs

#: Names that Hadoop gives to schemes which Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_store(uri: str, opener: str | None = None) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it. A plain path is a folder that all machines share.

    opener: "module:function" of a function (uri -> file system, path) that every worker can import, for schemes that Arrow
    doesn't know or that need credentials.
    """
    if opener:
        module, _, function = opener.partition(":")
        return getattr(importlib.import_module(module), function)(uri)
    scheme, found, rest = uri.partition("://")
    if not found:
        return fs.LocalFileSystem(), os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
