"""Files and directories as tasks see them. What is here runs on executors and is sent to them by value."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from shelfmark.session import by_value

by_value(__name__)

# Names of one store's schemes and the one that stands for them.
SAME_SCHEME = {"s3a": "s3", "s3n": "s3"}
DIRECTORY, FILE, OTHER, ERROR, PENDING = "directory", "file", "other", "error", "pending"


def is_remote(path: str) -> bool:
    return re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def local(path: str) -> str:
    """A local path without the scheme that may stand before it."""
    return re.sub(r"^file:/+", "/", path)


def remote(path: str):
    """(file system, path in it) of an object in a store."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1)
    return fs.FileSystem.from_uri(f"{SAME_SCHEME.get(scheme, scheme)}:{rest}")


def open_at(path: str, offset: int = 0):
    """A stream of the bytes of an object from ``offset`` on."""
    if not is_remote(path):
        stream = open(local(path), "rb")
        stream.seek(offset)
        return stream
    system, inner = remote(path)
    if not offset:
        return system.open_input_stream(inner)
    stream = system.open_input_file(inner)
    stream.seek(offset)
    return stream


def blocks(path: str, offset: int, length: int | None, block_size: int) -> Iterator[bytes]:
    """The bytes from ``offset`` on, up to ``length`` of them or all, in blocks."""
    with open_at(path, offset) as stream:
        left = length
        while left is None or left > 0:
            block = stream.read(block_size if left is None else min(block_size, left))
            if not block:
                return
            yield block
            if left is not None:
                left -= len(block)


def children(folder: str) -> Iterator[tuple]:
    """(path, kind, size, modification time, is a link, target, error) of everything directly in ``folder``.

    Size and time are those of a link's target, as its kind is. A name that is no valid Unicode, and a link
    that leads nowhere, come as errors.
    """
    if is_remote(folder):
        yield from _children_of_store(folder)
        return
    with os.scandir(local(folder)) as entries:
        for entry in entries:
            link = entry.is_symlink()
            try:
                entry.path.encode()
                target = os.readlink(entry.path) if link else None
                facts = entry.stat()
            except (OSError, UnicodeEncodeError) as error:
                shown = entry.path.encode(errors="replace").decode()
                yield shown, ERROR, None, None, link, None, f"{type(error).__name__}: {_clean(error)}"
                continue
            when = datetime.fromtimestamp(facts.st_mtime, timezone.utc)
            if stat.S_ISDIR(facts.st_mode):
                yield entry.path, DIRECTORY, None, when, link, target, None
            else:
                kind = FILE if stat.S_ISREG(facts.st_mode) else OTHER
                yield entry.path, kind, facts.st_size, when, link, target, None


def _children_of_store(folder: str) -> Iterator[tuple]:
    from pyarrow import fs

    system, inner = remote(folder)
    base = folder[: len(folder.rstrip("/")) - len(inner.rstrip("/"))] if folder.rstrip("/").endswith(inner.rstrip("/")) else ""
    for info in system.get_file_info(fs.FileSelector(inner)):
        kind = {fs.FileType.Directory: DIRECTORY, fs.FileType.File: FILE}.get(info.type, OTHER)
        yield base + info.path, kind, info.size, info.mtime, False, None, None


def _clean(error: Exception) -> str:
    return str(error).encode(errors="replace").decode()


def failure(error: Exception) -> str:
    return f"{type(error).__name__}: {_clean(error)}"
