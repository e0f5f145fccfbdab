"""Files by path for Python readers: local ones, and those of stores that Arrow's file systems reach."""

from __future__ import annotations

import fnmatch
import io
import os

from pyarrow import fs as pafs

BUFFER = 1 << 20
_WILD = "*?["


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of a folder's files, or of those that a pattern in the last part matches, by name."""
    fs, at = resolve(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    folder, _, last = at.rstrip("/").rpartition("/")
    if any(c in last for c in _WILD):
        found = [f for f in fs.get_file_info(pafs.FileSelector(folder or "/", allow_not_found=True)) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        one = fs.get_file_info(at.rstrip("/"))
        found = fs.get_file_info(pafs.FileSelector(one.path, allow_not_found=True)) if one.type == pafs.FileType.Directory else [one]
        found = [f for f in found if not f.base_name.startswith(("_", "."))] if one.type == pafs.FileType.Directory else found
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File)


def opened(path: str, start: int = 0) -> io.BufferedReader:
    """A file from byte ``start`` on, read through a buffer and never whole."""
    fs, at = resolve(path)
    if not start:
        return io.BufferedReader(fs.open_input_stream(at, compression=None), BUFFER)
    file = fs.open_input_file(at)
    file.seek(start)
    return io.BufferedReader(file, BUFFER)
