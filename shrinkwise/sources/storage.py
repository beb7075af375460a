"""Files by path or URI, opened on executors through pyarrow's file systems."""

from __future__ import annotations

import json
import os
import posixpath
import re
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs

from shrinkwise.sources.zip_directory import member_pieces

COPY_BYTES = 4 * 1024 * 1024
_ONE_SLASH = re.compile(r"^file:/(?!/)")


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file. A scheme that pyarrow does not know is an error."""
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(_ONE_SLASH.sub("file:///", root))
    return fs.LocalFileSystem(), os.path.abspath(root)


def read_head(path: str, size: int | None) -> bytes:
    """The first bytes of a file, or all of them with None; the rest is never read."""
    where, inner = open_root(path)
    with where.open_input_file(inner) as file:
        return file.read(size)


class RangedFile:
    """A file of which only the asked-for ranges are read."""

    def __init__(self, path: str):
        where, inner = open_root(path)
        self.file = where.open_input_file(inner)
        self.size = self.file.size()

    def read_at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def __enter__(self) -> RangedFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


#: Begins the source of a file that is a member of an archive: its place there follows as JSON.
MEMBER_SCHEME = "zip-member:"


def pieces_of(path: str) -> Iterator[bytes]:
    """The bytes of a file, or of an archive's member, a few megabytes at a time."""
    if path.startswith(MEMBER_SCHEME):
        place = json.loads(path[len(MEMBER_SCHEME) :])
        with RangedFile(place.pop("source")) as archive:
            yield from member_pieces(archive.read_at, **place)
        return
    where, inner = open_root(path)
    with where.open_input_stream(inner) as file:
        while data := file.read(COPY_BYTES):
            yield data


def below(base: str, relative: str) -> str:
    """Path of an output below the output root; one that would leave it is refused."""
    inner = posixpath.normpath(relative)
    if inner in (".", "..") or inner.startswith(("../", "/")):
        raise ValueError(f"output path leaves the output root: {relative}")
    return posixpath.join(base, inner)


def replace_file(where: fs.FileSystem, target: str, pieces: Iterable[bytes]) -> int:
    """Writes beside the target and renames, so a retried or speculative task leaves a whole file. Returns its size."""
    where.create_dir(posixpath.dirname(target), recursive=True)
    scratch, size = f"{target}.{uuid.uuid4().hex}.part", 0
    try:
        with where.open_output_stream(scratch) as out:
            for piece in pieces:
                out.write(piece)
                size += len(piece)
        where.move(scratch, target)
    except BaseException:
        if where.get_file_info(scratch).type != fs.FileType.NotFound:
            where.delete_file(scratch)
        raise
    return size
