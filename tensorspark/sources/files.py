"""Binary files on any file system that Arrow knows: mounted disks, S3, GCS, HDFS.

Tasks write parts under names of their own, and nothing is renamed or opened twice.  What
counts is what a manifest names; it is written last, under a number of its own, so a reader
sees the old state or the new one.  Parts of failed or repeated attempts are never named.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyarrow import fs as pafs

MANIFEST = "_manifest-"
# Bytes that a copy holds.
COPY_BYTES = 8 << 20


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, or of a path on a mounted disk."""
    scheme, colon, _ = uri.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), uri
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + uri.split(":", 1)[1].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *parts[1:]])


def names(filesystem: pafs.FileSystem, folder: str) -> list[str]:
    found = filesystem.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.File)


def folders(filesystem: pafs.FileSystem, folder: str) -> list[str]:
    found = filesystem.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)


def is_folder(filesystem: pafs.FileSystem, path: str) -> bool:
    return filesystem.get_file_info(path).type == pafs.FileType.Directory


def size_of(filesystem: pafs.FileSystem, path: str) -> int:
    info = filesystem.get_file_info(path)
    if info.type != pafs.FileType.File:
        raise ValueError(f"{path}: no such file")
    return info.size


def read_manifest(filesystem: pafs.FileSystem, folder: str) -> dict | None:
    """The newest complete manifest; one that its writer didn't finish is passed over."""
    for name in reversed([n for n in names(filesystem, folder) if n.startswith(MANIFEST)]):
        with filesystem.open_input_stream(join(folder, name)) as f:
            raw = f.read()
        try:
            return json.loads(raw)
        except ValueError:
            continue
    return None


def write_manifest(filesystem: pafs.FileSystem, folder: str, content: dict) -> str:
    """Publishes ``content``; returns the name of the manifest."""
    old = [n for n in names(filesystem, folder) if n.startswith(MANIFEST)]
    number = max((int(n[len(MANIFEST) :].split(".")[0]) for n in old), default=0) + 1
    name = f"{MANIFEST}{number:09d}.json"
    with filesystem.open_output_stream(join(folder, name)) as f:
        f.write(json.dumps(content).encode())
    return name


def remove(filesystem: pafs.FileSystem, folder: str, gone: Iterable[str]) -> None:
    for name in gone:
        filesystem.delete_file(join(folder, name))


def copy_range(source: pa.NativeFile, first: int, size: int, target: pa.NativeFile) -> None:
    """Appends bytes of a file to a stream, a bounded part at a time."""
    while size:
        piece = source.read_at(min(size, COPY_BYTES), first)
        if not len(piece):
            raise ValueError("file ends before its data")
        target.write(piece)
        first, size = first + len(piece), size - len(piece)
