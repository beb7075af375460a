"""Folder, image, label and audit readers."""

from __future__ import annotations

import os
import posixpath
import struct
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.config import FALLBACK_LANGUAGE, RASTER_EXTS
from shrinkwise.functions.paths import base_name, file_extension
from shrinkwise.operators.balance import by_bytes
from shrinkwise.operators.routing import not_archive
from shrinkwise.session import new_shared_path
from shrinkwise.sources.storage import open_root, read_head
from shrinkwise.sources.tables import AUDIT_SCHEMA

ARCHIVE_GLOB = "*.[zZ][iI][pP]"
BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LISTED_SCHEMA = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("modified", T.TimestampType()),
    ]
)
#: Bytes of a file that may become a value; longer ones are listed, copied by path, and never read into rows.
MAX_CONTENT = 2_000_000_000
FLUSH_BYTES = 32 * 1024 * 1024
#: Entries of a folder in one batch.
LISTED_PAGE = 10_000


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """All files below `root`, hidden ones too: path, rel_path, name, ext, size, modified.

    Executors list folder by folder, a level of the tree at a time; the folders of a level are dealt over all shuffle
    partitions. All levels are one table in the shared folder; the driver sees only how many folders a level had. A
    folder's entries are taken a page at a time. `root` is a path or a URI that pyarrow opens (file, hdfs, s3, gs). A
    folder that is not there holds no files.
    """
    arrow = to_arrow_schema(LISTED_SCHEMA)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = open_root(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = folder_entries(where, posixpath.join(base, folder) if folder else base)
                while rows := [(posixpath.join(folder, name), *rest) for name, *rest in islice(found, LISTED_PAGE)]:
                    columns = [pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(arrow)]
                    yield pa.record_batch(columns, schema=arrow)

    table, tasks = new_shared_path(spark, "listing"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, depth, dirs = spark.createDataFrame([("",)], "folder string"), 0, 1
    while dirs:
        seen, here = Observation(), f"{table}/level={depth}"
        found = level.repartition(min(tasks, dirs), "folder").mapInArrow(listed, LISTED_SCHEMA)
        found.observe(seen, F.count_if("is_dir").alias("dirs")).write.parquet(here)
        dirs, depth = seen.get["dirs"], depth + 1
        level = spark.read.schema(LISTED_SCHEMA).parquet(here).where("is_dir").select(F.col("rel_path").alias("folder"))
    path = F.concat(F.lit(root.rstrip("/") + "/"), "rel_path")
    files = spark.read.schema(LISTED_SCHEMA).parquet(table).where("not is_dir")
    return files.select(path.alias("path"), "rel_path", base_name("rel_path").alias("name"), file_extension("rel_path").alias("ext"), "size", "modified")


def folder_entries(
    where: fs.FileSystem, folder: str, wanted: Callable[[str], bool] | None = None, about: bool = True
) -> Iterator[tuple[str, bool, int | None, datetime | None]]:
    """(name, whether a folder, size, modified) of what is in a folder; local folders are never held whole.

    Files whose name is not wanted are left out before anything else is asked about them; so are size and time of
    all files without `about`.
    """
    if not isinstance(where, fs.LocalFileSystem):
        for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            is_dir = i.type == fs.FileType.Directory
            if is_dir or wanted is None or wanted(i.base_name):
                yield i.base_name, is_dir, i.size, i.mtime
        return
    try:
        found = os.scandir(folder or "/")
    except FileNotFoundError:
        return
    with found:
        for entry in found:
            is_dir = entry.is_dir()
            if not is_dir and wanted is not None and not wanted(entry.name):
                continue
            if not about:
                yield entry.name, is_dir, None, None
                continue
            try:
                known = entry.stat()
            except FileNotFoundError:  # Gone meanwhile, or a link to nothing.
                continue
            yield entry.name, is_dir, known.st_size, datetime.fromtimestamp(known.st_mtime, UTC)


def read_contents(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Adds `content` and `read_error`: each file is opened by its path and read whole on an executor.

    Files are dealt to tasks by their bytes (by_bytes), however few rows of metadata they are. A file above MAX_CONTENT, or one that cannot be read, has no content and its error.
    """
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def read(where: str, length: int) -> tuple[bytes | None, str | None]:
        try:
            if length > MAX_CONTENT:
                raise ValueError(f"file of {length} bytes is too large to be read")
            return read_head(where, None), None
        except Exception as exc:  # noqa: BLE001 - reported in the row
            return None, f"{type(exc).__name__}: {exc}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, size_held = 0, [], 0
            for i, (where, length) in enumerate(zip(batch.column(path).to_pylist(), batch.column(size).to_pylist(), strict=True)):
                held.append(read(where, length))
                size_held += len(held[-1][0] or b"")
                if size_held >= FLUSH_BYTES or i + 1 == batch.num_rows:
                    more = [pa.array([h[k] for h in held], type=arrow.field(n).type) for k, n in enumerate(("content", "read_error"))]
                    columns = [*batch.slice(first, len(held)).columns, *more]
                    yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                    first, held, size_held = i + 1, [], 0

    return by_bytes(files, size, (path,)).mapInArrow(work, schema)


def suffix_glob(exts: Iterable[str]) -> str:
    """File-name pattern matching any of the suffixes in any case."""
    cases = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in exts]
    return "*.{" + ",".join(cases) + "}"


def scan_files(
    spark: SparkSession, root: str, with_content: bool = False, exts: Iterable[str] | None = None
) -> DataFrame:
    """All files below `root` except archives, hidden ones too; `exts` keeps some types.

    Files are listed by list_tree and opened only with `with_content`, which adds content and read_error.
    """
    files = list_tree(spark, root).where(not_archive("ext"))
    if exts is not None:
        files = files.where(F.col("ext").isin(*exts))
    return read_contents(files) if with_content else files


def scan_archives(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """ZIP files below `root`, whatever the case of their suffix."""
    files = list_tree(spark, root).where(~not_archive("ext"))
    return read_contents(files) if with_content else files


IMAGE_SCHEMA = "path string, ext string, width int, height int, channels int, mode string, decodable boolean"
# PNG colour types and JPEG component counts, and JPEG's frame markers.
PNG_MODES = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
FRAME_MARKERS = frozenset((*range(0xC0, 0xD0),)) - {0xC4, 0xC8, 0xCC}


def image_header(head: bytes) -> tuple[int, int, int, str] | None:
    """Width, height, channels and mode of a PNG or JPEG file from its first bytes; None if it is neither."""
    if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR" and len(head) >= 26:
        width, height, _, colour = struct.unpack(">2I2B", head[16:26])
        return (width, height, PNG_MODES[colour][1], PNG_MODES[colour][0]) if colour in PNG_MODES else None
    at = 2
    while head[:2] == b"\xff\xd8" and at + 9 < len(head) and head[at] == 0xFF:
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if marker in FRAME_MARKERS:
            height, width, parts = struct.unpack(">2HB", head[at + 5 : at + 10])
            return (width, height, parts, JPEG_MODES[parts]) if parts in JPEG_MODES else None
        at += 2 + size if marker != 0xFF else 1
    return None


def file_image_header(path: str) -> tuple[int, int, int, str] | None:
    """image_header of a file, whatever stands before its frame: segments of a JPEG file are skipped unread."""
    where, inner = open_root(path)
    with where.open_input_file(inner) as file:
        head = file.read(26)
        if head[:2] != b"\xff\xd8":
            return image_header(head)
        at = 2
        while True:
            file.seek(at)
            head = file.read(10)
            if len(head) < 10 or head[0] != 0xFF:
                return None
            if head[1] in FRAME_MARKERS:
                return image_header(b"\xff\xd8" + head)
            at += 2 + int.from_bytes(head[2:4], "big") if head[1] != 0xFF else 1


def scan_images(spark: SparkSession, root: str, drop_invalid: bool = False) -> DataFrame:
    """Width, height, channels and mode of raster files, from their headers; no pixel is decoded.

    Files are opened by path on executors, for their first bytes and the starts of JPEG segments only. What is no PNG or JPEG
    file, or cannot be opened, shows -1 unless dropped.
    """
    files = list_tree(spark, root).where(F.col("ext").isin(*RASTER_EXTS)).select("path", "ext", F.lit(0).cast("bigint").alias("cost"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = file_image_header(path)
                except Exception:  # noqa: BLE001 - shown as undecodable
                    found = None
                width, height, channels, mode = found or (-1, -1, -1, None)
                rows.append((path, ext, width, height, channels, mode, found is not None))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            names = ("path", "ext", "width", "height", "channels", "mode", "decodable")
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.record_batch([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    images = by_bytes(files, "cost").drop("cost").mapInArrow(work, IMAGE_SCHEMA)
    return images.where("decodable") if drop_invalid else images


def read_labels(spark: SparkSession, folder: str, languages: Iterable[str] | None = None) -> DataFrame:
    """(lang, key, text) from one JSON object per `<lang>.json`; all values must be text.

    A file that is no JSON object gives no rows, so that lookups fall back to English; the English one fails the
    query when it is read, and so does a value that is no text in any.
    """
    raw = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(folder)
    lang = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.json$", 1)
    typed = raw.select(lang.alias("lang"), F.try_parse_json("value").alias("doc"))
    if languages is not None:
        typed = typed.where(F.col("lang").isin(*languages))
    # Numbers, booleans and nested values would be turned into text by a map<string,string> cast.
    entries = F.try_variant_get("doc", "$", "map<string,variant>")
    checked = typed.select(
        "lang",
        F.when(entries.isNull() & (F.col("lang") == FALLBACK_LANGUAGE), F.raise_error(F.concat(F.lit("label file is not an object: "), "lang")).cast("map<string,variant>"))
        .otherwise(entries)
        .alias("entries"),
    )
    rows = checked.select("lang", F.explode("entries").alias("key", "value"))
    is_text = F.schema_of_variant("value") == "STRING"
    return rows.select(
        "lang",
        "key",
        F.when(is_text, F.variant_get("value", "$", "string"))
        .otherwise(F.raise_error(F.concat(F.lit("label is not text: "), "key")).cast("string"))
        .alias("text"),
    )


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit CSV as written by write_audit; blank text fields come back as ''."""
    texts = [f.name for f in AUDIT_SCHEMA.fields if f.dataType.typeName() == "string"]
    return spark.read.schema(AUDIT_SCHEMA).option("header", "true").csv(path).fillna("", subset=texts)
