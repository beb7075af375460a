"""Reading ZIP files into member rows: listing and nested expansion, of archives given by path or as bytes."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from zipfile import BadZipFile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.config import ARCHIVE_EXT, MAX_NESTING, Quota
from shrinkwise.functions.paths import file_extension
from shrinkwise.operators.archives import first_violation
from shrinkwise.operators.balance import PIECE_BYTES, by_bytes, payload_slices
from shrinkwise.session import new_shared_path, saved_table
from shrinkwise.sources.scan import MAX_CONTENT
from shrinkwise.sources.storage import MEMBER_SCHEME, RangedFile, open_root, replace_file
from shrinkwise.sources.zip_directory import ReadAt, checked_entries, member_pieces

UNREADABLE, UNREADABLE_MEMBER, NESTING_LIMIT, OVER_TOTAL = "unreadable", "unreadable_member", "nesting_limit", "nested_size"

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("external_attr", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

EXPANDED_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("rel_path", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("member_count", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("error", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)

#: Inner archives up to this size are values in rows; larger ones become files in the shared folder.
INLINE_BYTES = 64 * 1024 * 1024
FLUSH_BYTES = PIECE_BYTES
FLUSH_ROWS = 2_000


def _batches(rows: Iterator[dict], schema: pa.Schema, payload: str | None = None) -> Iterator[pa.RecordBatch]:
    """Group rows into Arrow batches of limited size."""
    buffer: list[dict] = []
    held = 0
    for row in rows:
        buffer.append(row)
        held += len(row.get(payload) or b"") if payload else 0
        if held >= FLUSH_BYTES or len(buffer) >= FLUSH_ROWS:
            yield pa.RecordBatch.from_pylist(buffer, schema=schema)
            buffer, held = [], 0
    if buffer:
        yield pa.RecordBatch.from_pylist(buffer, schema=schema)


@contextmanager
def _opened(source: str | None, content: bytes | None) -> Iterator[tuple[ReadAt, int]]:
    """Ranged reads of an archive by its path, or of its bytes."""
    if source is not None:
        with RangedFile(source) as file:
            yield file.read_at, file.size
    elif content is None:
        raise BadZipFile("archive has no bytes")
    else:
        yield (lambda offset, length: content[offset : offset + length]), len(content)


def list_members(archives: DataFrame, path: str = "path", content: str | None = "content", source: str | None = None) -> DataFrame:
    """Members in directory order: archive_path, idx, name, file_size, external_attr.

    Archives are bytes in `content`, or, with `source`, files at the paths in that column: of those only the directory
    is read, a page at a time, so they may have any size. An unreadable archive gives one row with idx = -1 and its error.
    """
    schema = to_arrow_schema(LISTING_SCHEMA)

    def listed(batch: pa.RecordBatch) -> Iterator[dict]:
        for archive, blob, place in zip(*(batch.column(i) for i in range(3)), strict=True):
            where = archive.as_py()
            try:
                with _opened(place.as_py(), blob.as_py()) as (read_at, size):
                    for e in checked_entries(read_at, size):
                        yield {"archive_path": where, "idx": e.idx, "name": e.name, "file_size": e.file_size, "external_attr": e.external_attr}
            except Exception as exc:  # noqa: BLE001 - reported in the row
                yield {"archive_path": where, "idx": -1, "error": f"{type(exc).__name__}: {exc}"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(listed(batch), schema)

    rows = archives.select(F.col(path), *_bytes_or_path(content, source))
    if source:
        rows = by_bytes(rows.withColumn("cost", F.lit(0).cast("bigint")), "cost", ("source",)).drop("cost")
    return rows.mapInArrow(work, LISTING_SCHEMA)


def _bytes_or_path(content: str | None, source: str | None) -> list[Column]:
    return [
        (F.col(content) if content and not source else F.lit(None).cast("binary")).alias("content"),
        (F.col(source) if source else F.lit(None).cast("string")).alias("source"),
    ]


class ArchiveMembers:
    """Table function behind `archive_members(content)`."""

    def eval(self, content: bytes):
        with _opened(None, content) as (read_at, size):
            for e in checked_entries(read_at, size):
                yield e.idx, e.name, e.file_size, e.external_attr


def register_archive_members(spark: SparkSession, name: str = "archive_members") -> None:
    """SQL form of the listing: SELECT a.path, m.* FROM archives a, LATERAL archive_members(a.content) m.

    Unlike list_members, an unreadable archive fails the query.
    """
    returns = "idx int, name string, file_size bigint, external_attr bigint"
    spark.udtf.register(name, F.udtf(ArchiveMembers, returnType=returns))


#: What is needed to read a member besides its archive.
MEMBER_PLACE = [
    T.StructField("offset", T.LongType()),
    T.StructField("packed_size", T.LongType()),
    T.StructField("method", T.IntegerType()),
    T.StructField("crc", T.LongType()),
    T.StructField("flags", T.IntegerType()),
]
PLACE = [f.name for f in MEMBER_PLACE]
LEVEL_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("container", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("idx", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("external_attr", T.LongType()),
        *MEMBER_PLACE,
        T.StructField("error", T.StringType()),
    ]
)
CONTAINER = ["archive_path", "container"]


def _level_listing(level: DataFrame) -> DataFrame:
    """Members of every container; a row with idx -1 stands for the container, with its error if unreadable."""
    schema = to_arrow_schema(LEVEL_SCHEMA)
    told = ("idx", "name", "file_size", "external_attr", *PLACE)

    def listed(batch: pa.RecordBatch) -> Iterator[dict]:
        for archive, container, depth, blob, source in zip(*(batch.column(i).to_pylist() if i < 3 else batch.column(i) for i in range(5)), strict=True):
            own = {"archive_path": archive, "container": container, "source": source.as_py(), "depth": depth}
            size, error = 0, None
            try:
                with _opened(source.as_py(), blob.as_py()) as (read_at, size):
                    for e in checked_entries(read_at, size):
                        yield {**own, **{c: getattr(e, c) for c in told}}
            except Exception as exc:  # noqa: BLE001 - reported in the row
                error = f"{type(exc).__name__}: {exc}"
            yield {**own, "idx": -1, "file_size": size, "error": error}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(listed(batch), schema)

    return level.select(*CONTAINER, "depth", "content", "source").mapInArrow(work, LEVEL_SCHEMA)


def _judged(listed: DataFrame, quota: Quota, earlier: DataFrame | None) -> DataFrame:
    """A verdict per container: first_violation on its members, then the limit on the sum over all levels."""
    members = listed.where("idx >= 0").select(F.struct(*CONTAINER).alias("archive_path"), "idx", "name", "file_size", "external_attr")
    found = first_violation(members, quota).select("archive_path.*", "member_count", "total_bytes", "violation")
    heads = listed.where("idx = -1").select(*CONTAINER, "depth", "file_size", F.col("error").alias("_error"))
    judged = heads.join(found, CONTAINER, "left").withColumns(
        {
            "error": F.when(F.col("_error").isNotNull(), UNREADABLE).otherwise(F.col("violation")),
            "total_bytes": F.coalesce("total_bytes", F.lit(0)),
        }
    )
    if earlier is not None:
        here = judged.where("error is null").select("archive_path", "total_bytes")
        spent = earlier.where("error is null").select("archive_path", "total_bytes").unionByName(here)
        spent = spent.groupBy("archive_path").agg(F.sum("total_bytes").alias("_spent")).where(F.col("_spent") > quota.max_total_bytes)
        judged = judged.join(spent, "archive_path", "left")
        judged = judged.withColumn("error", F.when(F.col("error").isNull() & F.col("_spent").isNotNull(), OVER_TOTAL).otherwise(F.col("error")))
    count = F.when(F.col("error").isNull(), F.coalesce("member_count", F.lit(0))).otherwise(0).cast("bigint")
    return judged.select(*CONTAINER, "depth", "file_size", count.alias("member_count"), "total_bytes", "error")


def _placed(listed: DataFrame, judged: DataFrame) -> DataFrame:
    """Files of accepted containers at the path where they land: beside the archive that held them."""
    parts = F.filter(F.split(F.replace("name", F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    folder = F.when(F.contains("container", F.lit("/")), F.regexp_replace("container", "/[^/]*$", ""))
    files = listed.where("idx >= 0 and not endswith(name, '/')").withColumn("_parts", parts).where(F.size("_parts") > 0)
    files = files.join(judged.where("error is null").select(*CONTAINER), CONTAINER, "left_semi")
    target = F.concat_ws("/", folder, F.array_join("_parts", "/"))
    return files.select(*CONTAINER, "source", "depth", "idx", "file_size", *PLACE, target.alias("target")).withColumn(
        "is_archive", F.lower("target").endswith(f".{ARCHIVE_EXT}")
    )


def _last_written(placed: DataFrame) -> DataFrame:
    """Of members at one path the one written last: the deeper level, then the later container and member."""
    last = placed.groupBy("archive_path", "target").agg(F.max(F.struct("depth", "container", "idx", "file_size", "source", *PLACE)).alias("_last"))
    return last.select("archive_path", "target", "_last.*")


def _member_locator() -> Column:
    """The source under which pieces_of finds a member of an archive given by path."""
    return F.concat(F.lit(MEMBER_SCHEME), F.to_json(F.struct("source", "file_size", *PLACE)))


def _read_members(contents: DataFrame, wanted: DataFrame, folder: str | None = None) -> DataFrame:
    """Bytes of the wanted members; one that cannot be read has an error instead.

    Members of archives that have a path are read by their offsets, dealt to tasks by packed bytes, so that one archive may
    be read by many; the others are read where their archive's bytes are. With `folder`, members above INLINE_BYTES are
    written to files there and have a `source`. Members that are not wanted `as_bytes` are only checked, piece by piece.
    """
    schema = to_arrow_schema(EXPANDED_SCHEMA)

    def member(read_at: ReadAt, row: dict) -> dict:
        out = {"kind": "member", "payload": None, "error": None, "source": row["locator"]}
        out |= {"rel_path": row["target"]} | {c: row[c] for c in (*CONTAINER, "depth", "idx", "file_size")}
        pieces = member_pieces(read_at, file_size=row["file_size"], **{c: row[c] for c in PLACE})
        try:
            if folder is not None and row["file_size"] > INLINE_BYTES:
                where, base = open_root(folder)
                # One name for each member, whichever attempt writes it.
                name = uuid.uuid5(uuid.NAMESPACE_URL, "\n".join([row["archive_path"], row["container"], str(row["idx"])])).hex
                replace_file(where, posixpath.join(base, name), pieces)
                out["source"] = f"{folder}/{name}"
            elif not row["as_bytes"]:
                for _ in pieces:
                    pass
            elif row["file_size"] > MAX_CONTENT:
                raise ValueError(f"member of {row['file_size']} bytes is too large to be read")
            else:
                out["payload"] = b"".join(pieces)
        except Exception as exc:  # noqa: BLE001 - reported in the row
            out["error"] = f"{type(exc).__name__}: {exc}"
        return out

    def by_path(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            file, at = None, None
            try:
                for batch in batches:
                    for row in batch.to_pylist():
                        try:
                            if row["source"] != at:
                                if file is not None:
                                    file.file.close()
                                file, at = RangedFile(row["source"]), row["source"]
                            read_at = file.read_at
                        except Exception as exc:  # noqa: BLE001 - each member reports it
                            file, at, failed = None, None, exc

                            def read_at(offset: int, length: int, failed: Exception = failed) -> bytes:
                                raise failed

                        yield member(read_at, row)
            finally:
                if file is not None:
                    file.file.close()

        yield from _batches(rows(), schema, "payload")

    def by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in payload_slices(batches, 0):

            def rows(batch: pa.RecordBatch = batch) -> Iterator[dict]:
                for blob, wanted in zip(batch.column(0), batch.column(1), strict=True):
                    data = blob.as_py()
                    for row in wanted.as_py():
                        yield member(lambda offset, length: data[offset : offset + length], row)

            yield from _batches(rows(), schema, "payload")

    if "as_bytes" not in wanted.columns:
        wanted = wanted.withColumn("as_bytes", F.lit(True))
    columns = [*CONTAINER, "source", "target", "depth", "idx", "file_size", "as_bytes", *PLACE]
    wanted = wanted.select(*columns, F.when(F.col("source").isNotNull(), _member_locator()).alias("locator"))
    ranged = by_bytes(wanted.where("source is not null"), "packed_size", ("source", "offset"))
    lists = wanted.where("source is null").groupBy(*CONTAINER).agg(F.sort_array(F.collect_list(F.struct("idx", *[c for c in wanted.columns if c != "idx"]))).alias("wanted"))
    held = contents.where("source is null").join(lists, CONTAINER).select("content", "wanted")
    return held.mapInArrow(by_value, EXPANDED_SCHEMA).unionByName(ranged.mapInArrow(by_path, EXPANDED_SCHEMA))


def expand_archives(
    archives: DataFrame,
    max_depth: int = MAX_NESTING,
    quota: Quota = Quota(),
    path: str = "path",
    content: str | None = "content",
    source: str | None = None,
    exts: Iterable[str] | None = None,
) -> DataFrame:
    """Unpack archives, and archives inside them, into rows.

    kind = 'archive': one verdict per archive met (error null when accepted, member_count incl.
    directories). kind = 'member': the surviving files with their bytes; one that cannot be read has
    an error instead. Archives below `max_depth` are not opened and have the error `nesting_limit`.

    Archives are bytes in `content`, or, with `source`, files at the paths in that column. Of files only directories and
    wanted members are read, by their offsets, so archives of any size are opened and one of them is read by many tasks. Members of
    such archives have a `source` that write_payloads copies from; with `exts`, only members of these types
    become bytes in rows if they have one, the others are only checked.

    Members are listed level by level and judged by first_violation before anything is read; only archives inside
    accepted ones are then read to be listed in turn, large ones into files of the shared folder. The listings, verdicts and inner
    archives of each level are tables in the shared folder, so calling this runs a few jobs per level of nesting; files are read
    when the returned frame is. `archives` is read twice, once to be listed: save it first if it is costly to make.
    """
    names = F.col(path).alias("archive_path"), F.lit("").alias("container"), F.lit(0).alias("depth")
    level = archives.select(*names, *_bytes_or_path(content, source))
    if source:
        level = by_bytes(level.withColumn("cost", F.lit(0).cast("bigint")), "cost", ("source",)).drop("cost")
    folder = new_shared_path(archives.sparkSession, "inner-files")
    contents, verdicts, tree, opened = level, None, None, None
    for depth in range(max_depth):
        listed = saved_table(_level_listing(level), "listing")
        judged = saved_table(_judged(listed, quota, verdicts), "verdicts")
        verdicts = judged if verdicts is None else verdicts.unionByName(judged)
        placed = saved_table(_placed(listed, judged), "members")
        tree = placed if tree is None else tree.unionByName(placed)
        if placed.where("is_archive").isEmpty():
            break
        inner = _last_written(placed.where("is_archive"))
        if opened is not None:
            inner = inner.join(opened, ["archive_path", "target"], "left_anti")
        inner = saved_table(inner, "inner")
        if inner.isEmpty():
            break
        found = inner.select("archive_path", "target")
        opened = found if opened is None else opened.unionByName(found)
        if depth + 1 == max_depth:
            unopened = inner.select(
                "archive_path", F.col("target").alias("container"), F.lit(max_depth).alias("depth"), "file_size",
                F.lit(0).cast("bigint").alias("member_count"), F.lit(0).cast("bigint").alias("total_bytes"), F.lit(NESTING_LIMIT).alias("error"),
            )
            verdicts = verdicts.unionByName(unopened)
            break
        read = _read_members(level, inner, folder)
        in_file = F.col("payload").isNull() & F.col("error").isNull()
        level = saved_table(
            read.select(
                "archive_path", F.col("rel_path").alias("container"), (F.col("depth") + 1).alias("depth"), F.col("payload").alias("content"),
                F.when(in_file, F.col("source")).alias("source"),
            ),
            "level",
        )
        contents = contents.unionByName(level)
    files = _last_written(tree.where("not is_archive"))
    # Without bytes in rows: what has a path and a type nobody asked for, or is too large for a value.
    asked = file_extension("target").isin(*exts) & (F.col("file_size") <= MAX_CONTENT) if exts is not None else F.lit(True)
    members = _read_members(contents, files.withColumn("as_bytes", F.col("source").isNull() | asked))
    return members.unionByName(_in_schema(verdicts.withColumn("kind", F.lit("archive"))))


def _in_schema(rows: DataFrame) -> DataFrame:
    """The columns of an expansion, null where `rows` has none."""
    return rows.select(*[f.name if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EXPANDED_SCHEMA])


def expanded_members(expanded: DataFrame) -> DataFrame:
    return expanded.where((F.col("kind") == "member") & F.col("error").isNull())


def unreadable_members(expanded: DataFrame) -> DataFrame:
    """Members of accepted archives that could not be read, with their errors."""
    return expanded.where((F.col("kind") == "member") & F.col("error").isNotNull())


def expanded_verdicts(expanded: DataFrame) -> DataFrame:
    """One row per archive met, in the shape archive_outcomes reads; one with an unreadable member has failed."""
    damaged = unreadable_members(expanded).select(*CONTAINER).distinct().withColumn("_damaged", F.lit(UNREADABLE_MEMBER))
    heads = expanded.where(F.col("kind") == "archive").join(damaged, CONTAINER, "left")
    return heads.select(*CONTAINER, "depth", "member_count", F.coalesce("error", "_damaged").alias("violation"))
