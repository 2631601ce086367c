"""Byte access to local paths and to URIs that Arrow's file systems open."""

from __future__ import annotations

import mmap
import os
import re
from urllib.parse import unquote


def local(path: str) -> str | None:
    """The path on this machine, or None for another store."""
    if path.startswith("file:"):
        return unquote(re.sub(r"^file:(//)?", "", path))
    return path if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+://", path) else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def size_of(path: str) -> int:
    if (here := local(path)) is not None:
        return os.path.getsize(here)
    store, inner = _store(path)
    return store.get_file_info(inner).size


def exists(path: str) -> bool:
    """Whether there is a file; a store that can't be reached has none."""
    try:
        if (here := local(path)) is not None:
            return os.path.isfile(here)
        store, inner = _store(path)
        return store.get_file_info(inner).is_file
    except (OSError, ValueError):
        return False


def files_of(folder: str) -> list[str]:
    """Names of a folder's files, but for hidden ones."""
    if (here := local(folder)) is not None:
        names = [x.name for x in os.scandir(here) if x.is_file()]
    else:
        from pyarrow import fs

        store, inner = _store(folder)
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(inner)) if x.is_file]
    return sorted(x for x in names if x[0] not in "._")


class FileBytes:
    """Positional reads."""

    def __init__(self, path: str):
        here = local(path)
        if here is not None:
            self.file = open(here, "rb")  # noqa: SIM115
        else:
            store, inner = _store(path)
            self.file = store.open_input_file(inner)
        self.here = here

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def mapped(self):
        """Something with find and slices over the whole file: a memory map, or the bytes of another store's file."""
        if self.here is not None and os.path.getsize(self.here):
            return mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        self.file.seek(0)
        return self.file.read()

    def __enter__(self) -> FileBytes:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()
