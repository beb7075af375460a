"""Folders as Spark sources: a batch of all files below a root, and a stream of new and changed ones."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from shrinkwise.sources.scan import LISTED_PAGE, folder_entries
from shrinkwise.sources.storage import open_root

FOLDER_FORMAT, INTAKE_FORMAT = "folder_files", "folder_intake"
FOLDER_SCHEMA = StructType(
    [*[StructField(c, StringType()) for c in ("path", "rel_path", "name", "ext")], StructField("size", LongType()), StructField("modified", TimestampType())]
)
#: Folders that planning opens at most, to find work for many tasks; deeper ones are walked by the task that has them.
PLANNED_FOLDERS = 1000
#: Files of one folder that a task looks at, about, and tasks that share one folder at most.
SHARE_FILES = 10_000
MOST_SHARES = 64


@dataclass
class Work(InputPartition):
    """A folder's own files, those whose name hashes to `share` of `shares`, or all below it."""

    folder: str
    below: bool
    share: int = 0
    shares: int = 1


def name_ext(name: str) -> str:
    """Lower-case suffix of a name, by the rule of file_extension."""
    tail = name.rpartition(".")[2]
    return tail.lower() if len(name) > len(tail) + 1 else ""


_TESTS = {
    EqualTo: lambda v, given: v == given,
    In: lambda v, given: v in given,
    GreaterThan: lambda v, given: v > given,
    GreaterThanOrEqual: lambda v, given: v >= given,
    LessThan: lambda v, given: v < given,
    LessThanOrEqual: lambda v, given: v <= given,
}
_PUSHED = ("ext", "size", "modified")


class FolderReader(DataSourceReader):
    """Lists folders in tasks. Tests on ext come before a file's size and time are asked for, all before rows are made."""

    def __init__(self, root: str):
        self.root = root
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if type(f) in _TESTS and len(f.attribute) == 1 else None
            given = f.value if column in _PUSHED else None
            if column not in _PUSHED or given is None or (column == "modified" and type(f) is In):
                yield f
            else:
                self.tests.append((column, type(f), given))

    def partitions(self) -> Sequence[InputPartition]:
        where, base = open_root(self.root)
        waiting, planned, opened = [""], [], 0
        while waiting and opened < PLANNED_FOLDERS:
            folder, files, opened = waiting.pop(0), 0, opened + 1
            for name, is_dir, *_ in folder_entries(where, posixpath.join(base, folder), about=False):
                if is_dir:
                    waiting.append(posixpath.join(folder, name))
                else:
                    files += 1
            shares = min(MOST_SHARES, -(-files // SHARE_FILES))
            planned += [Work(folder, False, k, shares) for k in range(shares)]
        return planned + [Work(folder, True) for folder in waiting] or [Work("", False)]

    def read(self, partition: Work, keep: Callable[[tuple], bool] | None = None) -> Iterator[pa.RecordBatch]:
        where, base = open_root(self.root)
        arrow = to_arrow_schema(FOLDER_SCHEMA)
        found = filter(keep, self._files(where, base, partition)) if keep else self._files(where, base, partition)
        while rows := list(islice(found, LISTED_PAGE)):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def _files(self, where: fs.FileSystem, base: str, work: Work) -> Iterator[tuple]:
        def wanted(name: str) -> bool:
            if work.shares > 1 and crc32(name.encode("utf-8", "surrogatepass")) % work.shares != work.share:
                return False
            return all(_TESTS[kind](name_ext(name), given) for column, kind, given in self.tests if column == "ext")

        later = [t for t in self.tests if t[0] != "ext"]
        folders = [work.folder]
        while folders:
            folder = folders.pop()
            for name, is_dir, size, modified in folder_entries(where, posixpath.join(base, folder), wanted):
                rel_path = posixpath.join(folder, name)
                if is_dir:
                    folders += [rel_path] if work.below else []
                elif all(_TESTS[kind](_same_kind(size if column == "size" else modified, given), given) for column, kind, given in later):
                    yield f"{self.root.rstrip('/')}/{rel_path}", rel_path, name, name_ext(name), size, modified


def _same_kind(value: object, given: object) -> object:
    """A time with or without its zone, as the one it is compared with."""
    if isinstance(value, datetime) and isinstance(given, datetime):
        return value.astimezone(UTC).replace(tzinfo=None) if given.tzinfo is None else value
    return value


class FolderFiles(DataSource):
    """spark.read.format("folder_files").load(root): all files below a path or URI, hidden ones too, without contents.

    Planning opens the first folders, breadth-first, so that tasks get folders, shares of large folders, or whole
    subtrees; no task holds a folder, and the driver holds folders only. Comparisons of ext, size and modified with
    constants are decided where files are listed.
    """

    @classmethod
    def name(cls) -> str:
        return FOLDER_FORMAT

    def schema(self) -> StructType:
        return FOLDER_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FolderReader(self.options["path"])


class IntakeReader(DataSourceStreamReader):
    """New and changed files between two offsets, which are the (modified, path) of the last file taken."""

    def __init__(self, root: str):
        self.listing = FolderReader(root)
        self.last = (-1, "")

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The newest file's place; of all that is listed only this is kept. Offsets never go back."""
        where, base = open_root(self.listing.root)
        newest = max((_place(row) for row in self.listing._files(where, base, Work("", True))), default=(-1, ""))
        self.last = max(self.last, newest)
        return {"modified": self.last[0], "path": self.last[1]}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        first, last = ((o["modified"], o["path"]) for o in (start, end))
        self.last = max(self.last, last)
        return [Between(w.folder, w.below, w.share, w.shares, first, last) for w in self.listing.partitions()] if first < last else []

    def read(self, partition: Between) -> Iterator[pa.RecordBatch]:
        return self.listing.read(partition, lambda row: partition.first < _place(row) <= partition.last)


@dataclass
class Between(Work):
    """Of some work the files behind `first`, up to `last`."""

    first: tuple[int, str] = (-1, "")
    last: tuple[int, str] = (-1, "")


def _place(row: tuple) -> tuple[int, str]:
    """Where a file stands in the stream: its time in microseconds, then its path."""
    return round(row[5].timestamp() * 1_000_000), row[1]


class FolderIntake(DataSource):
    """spark.readStream.format("folder_intake").load(root): files below a path or URI as they come or change.

    Hidden names are files like others. A file that changes comes again with its new time. Offsets are (modified, path), so a
    stream that is started again goes on behind the last file it took, and its checkpoint does not grow with the files; a file that
    is put there later with an older time than that is not seen. Each batch is listed by tasks, as FolderFiles is.
    Contents are read by path (read_contents in a batch), so a file too large for a value ends nothing.
    """

    @classmethod
    def name(cls) -> str:
        return INTAKE_FORMAT

    def schema(self) -> StructType:
        return FOLDER_SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return IntakeReader(self.options["path"])


def register_folder_sources(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderFiles)
    spark.dataSource.register(FolderIntake)
