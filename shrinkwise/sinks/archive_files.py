"""Regrouping files into ZIP archives of any size without holding an archive in one task.

Members are deflated where they are, large ones as blocks by many tasks. An archive that surely fits one part of `part_bytes` is put together in one
group. Of larger ones only the members' sizes are ordered to find each member's offset, and the compressed bytes
are shuffled once, to the (archive, part) they belong to, a consecutive stretch of the file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.functions.paths import ancestor_dirs
from shrinkwise.operators.skew import running_sums, spread_join
from shrinkwise.session import saved_table
from shrinkwise.sinks.deflated_blocks import BLOCK_BYTES, content_blocks, source_blocks, whole_members

PART_BYTES = 32 * 1024 * 1024

# Fixed values of the ZIP format (PKWARE application note).
LOCAL_HEADER, CENTRAL_HEADER = 30, 46
OFFSET_EXTRA = 12
SIZES_EXTRA = 20
END_RECORD, LONG_END_RECORDS = 22, 76
LIMIT_32, LIMIT_16 = 0xFFFFFFFF, 0xFFFF
DEFLATED, STORED = 8, 0
FIRST_DOS_DATE = 0x0021
UTF8_NAMES = 0x0800
MADE_BY_UNIX = 3 << 8
FILE_ATTR, DIR_ATTR = 0o100644 << 16, (0o040755 << 16) | 0x10

PART_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("parts", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("archive_bytes", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def _is_long(row: dict) -> bool:
    return row["packed_size"] >= LIMIT_32 or row["raw_size"] >= LIMIT_32


def _local_entry(row: dict) -> bytes:
    """Header of an entry, and its bytes if the row has them."""
    name = row["name"].encode()
    is_dir = row["name"].endswith("/")
    flags = UTF8_NAMES if not name.isascii() else 0
    long = _is_long(row)
    extra = struct.pack("<2H2Q", 1, 16, row["raw_size"], row["packed_size"]) if long else b""
    header = struct.pack(
        "<4s5H3L2H", b"PK\x03\x04", 45 if long else 20, flags, STORED if is_dir else DEFLATED, 0, FIRST_DOS_DATE, row["crc"],
        LIMIT_32 if long else row["packed_size"], LIMIT_32 if long else row["raw_size"], len(name), len(extra),
    )
    return header + name + extra + (row["packed"] or b"")


def _central_entry(row: dict) -> bytes:
    name = row["name"].encode()
    is_dir = row["name"].endswith("/")
    flags = UTF8_NAMES if not name.isascii() else 0
    far, long = row["far"], _is_long(row)
    wide = ([row["raw_size"], row["packed_size"]] if long else []) + ([row["entry_offset"]] if far else [])
    extra = struct.pack(f"<2H{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    version = 45 if wide else 20
    header = struct.pack(
        "<4s6H3L5H2L", b"PK\x01\x02", MADE_BY_UNIX | version, version, flags,
        STORED if is_dir else DEFLATED, 0, FIRST_DOS_DATE, row["crc"],
        LIMIT_32 if long else row["packed_size"], LIMIT_32 if long else row["raw_size"],
        len(name), len(extra), 0, 0, 0, DIR_ATTR if is_dir else FILE_ATTR,
        LIMIT_32 if far else row["entry_offset"],
    )
    return header + name + extra


def _end_record(entries: int, directory_size: int, directory_start: int) -> bytes:
    tail = b""
    if entries > LIMIT_16 - 1 or directory_start >= LIMIT_32 or directory_size >= LIMIT_32:
        end = directory_start + directory_size
        tail = struct.pack(
            "<4sQ2H2L4Q", b"PK\x06\x06", 44, MADE_BY_UNIX | 45, 45, 0, 0, entries, entries, directory_size, directory_start
        ) + struct.pack("<4sLQL", b"PK\x06\x07", 0, end, 1)
    return tail + struct.pack(
        "<4s4H2LH", b"PK\x05\x06", 0, 0, min(entries, LIMIT_16), min(entries, LIMIT_16),
        min(directory_size, LIMIT_32), min(directory_start, LIMIT_32), 0,
    )


LOCAL, CENTRAL, END, BLOCK = 0, 1, 2, 3


SEGMENT_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("parts", T.LongType()),
        T.StructField("file_count", T.LongType()),
        T.StructField("archive_bytes", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("bytes", T.BinaryType()),
    ]
)


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each planned segment as the bytes it contributes to its archive."""
    schema = to_arrow_schema(SEGMENT_SCHEMA)
    carried = schema.names[:-1]
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["section"] == LOCAL:
                data = _local_entry(row)
            elif row["section"] == BLOCK:
                data = row["packed"]
            elif row["section"] == CENTRAL:
                data = _central_entry(row)
            else:
                data = _end_record(row["entries"], row["directory_size"], row["directory_start"])
            rows.append({**{c: row[c] for c in carried}, "bytes": data})
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _assemble(group: pa.Table) -> pa.Table:
    """Join the segments of one part in file order."""
    ordered = group.sort_by("position")
    first = ordered.slice(0, 1).to_pylist()[0]
    part = {
        "archive_path": first["archive_path"], "part": first["part"], "parts": first["parts"],
        "start": first["position"], "file_count": first["file_count"], "archive_bytes": first["archive_bytes"],
        "content": b"".join(ordered.column("bytes").to_pylist()),
    }
    return pa.Table.from_pylist([part], schema=to_arrow_schema(PART_SCHEMA))


def _ancestors(name: str) -> set[str]:
    """Folders above a name, each ending in '/'; a name that ends so is a folder itself."""
    parts = name.split("/")[:-1]
    return {folder + "/" for k in range(1, len(parts) + 1) if (folder := "/".join(parts[:k]))}


def _joined(blocks: list[dict]) -> dict:
    """A member from its blocks in order."""
    crc = 0
    for block in blocks:
        crc ^= block["crc"]
    sizes = {c: sum(b[c] for b in blocks) for c in ("raw_size", "packed_size")}
    return {**sizes, "name": blocks[0]["name"], "crc": crc, "packed": b"".join(b["packed"] for b in blocks)}


def _whole_archive(group: pa.Table) -> pa.Table:
    """An archive that fits one part, from all of its entries: the same bytes as the planned segments make."""
    rows = group.to_pylist()
    members: dict[str, list[dict]] = {}
    for row in sorted((r for r in rows if not r["name"].endswith("/")), key=lambda r: (r["name"], r["block"])):
        members.setdefault(row["name"], []).append(row)
    files = [_joined(blocks) for blocks in members.values()]
    folders = sorted(set().union(*(_ancestors(r["name"]) for r in rows)))
    blank = {"crc": 0, "raw_size": 0, "packed_size": 0, "packed": None}
    local, central, at = [], [], 0
    for row in [*({**blank, "name": folder} for folder in folders), *files]:
        local.append(_local_entry(row))
        central.append(_central_entry({**row, "far": False, "entry_offset": at}))
        at += len(local[-1])
    directory = b"".join(central)
    content = b"".join([*local, directory, _end_record(len(local), len(directory), at)])
    part = {
        "archive_path": rows[0]["archive_path"], "part": 0, "parts": 1, "start": 0, "file_count": len(files),
        "archive_bytes": len(content), "content": content,
    }
    return pa.Table.from_pylist([part], schema=to_arrow_schema(PART_SCHEMA))


def _with_dirs(entries: DataFrame) -> DataFrame:
    """Sizes of all entries, one row each: the files and every folder above them or given as 'x/'."""
    sizes = whole_members(entries)
    folder_paths = F.when(F.endswith("name", F.lit("/")), F.concat("name", F.lit("-"))).otherwise(F.col("name"))
    dirs = (
        sizes.select("archive_path", F.explode(ancestor_dirs(folder_paths)).alias("dir"))
        .distinct()
        .select(
            "archive_path",
            F.concat("dir", F.lit("/")).alias("name"),
            *[F.lit(0).cast("bigint").alias(c) for c in ("crc", "raw_size", "packed_size")],
        )
    )
    files = sizes.where(~F.endswith("name", F.lit("/")))
    return files.withColumn("rank_group", F.lit(1)).unionByName(dirs.withColumn("rank_group", F.lit(0)))


def pack_archives(
    files: DataFrame,
    group: str = "archive_path",
    name: str = "rel_path",
    content: str = "content",
    part_bytes: int = PART_BYTES,
    source: str | None = None,
    size: str = "size",
    block_bytes: int = BLOCK_BYTES,
    task_bytes: int | None = None,
) -> DataFrame:
    """One deflated ZIP per group: archive_path, part, parts, start, file_count, archive_bytes, content.

    Folders come first, then files, both by path; names ending in '/' are empty folders. Names are
    unique in an archive. Parts joined in order (or written at `start`) are the archive; part
    numbers rise but may skip where one block is longer than a part.

    With `source`, rows without bytes are read from the path in that column, which has the bytes that `size` says: blocks
    of `block_bytes` by many tasks, so that a member of any size never is one value or one task's work. Members and
    archives beyond four gigabytes have the format's long sizes.
    """
    named = files.select(F.col(group).alias("archive_path"), F.col(name).alias("name"), F.col(content).alias("content"), *([F.col(source).alias("source"), F.col(size).cast("bigint").alias("size")] if source else []))
    if source:
        by_path = F.col("content").isNull() & F.col("source").isNotNull()
        blocks = content_blocks(named.where(~by_path), block_bytes).unionByName(source_blocks(named.where(by_path), block_bytes, task_bytes))
    else:
        blocks = content_blocks(named, block_bytes)
    entries = saved_table(blocks, "entries")
    # What an entry and the folders above it may add to an archive, at most.
    slashes = F.length("name") - F.length(F.replace("name", F.lit("/"), F.lit(""))) + 1
    most = F.col("packed_size") + slashes * (2 * F.octet_length("name") + LOCAL_HEADER + CENTRAL_HEADER + OFFSET_EXTRA + 2 * SIZES_EXTRA)
    bounds = entries.groupBy("archive_path").agg(F.sum(most).alias("most"), F.sum(slashes).alias("names"))
    fits = (F.col("most") + END_RECORD + LONG_END_RECORDS < part_bytes) & (F.col("names") < LIMIT_16)
    large = saved_table(bounds.where(~fits).select("archive_path"), "large")
    if large.isEmpty():
        return entries.groupBy("archive_path").applyInArrow(_whole_archive, PART_SCHEMA)
    small = entries.join(large, "archive_path", "left_anti").groupBy("archive_path").applyInArrow(_whole_archive, PART_SCHEMA)
    return small.unionByName(_large_archives(entries.join(large, "archive_path", "left_semi"), part_bytes))


def _large_archives(entries: DataFrame, part_bytes: int) -> DataFrame:
    """Parts of archives that need not fit one task: offsets by running sums, bytes shuffled once to their part."""
    sized = _with_dirs(entries).withColumns(
        {
            "name_bytes": F.octet_length("name").cast("bigint"),
            "one": F.lit(1).cast("bigint"),
        }
    )
    long = (F.col("packed_size") >= LIMIT_32) | (F.col("raw_size") >= LIMIT_32)
    sized = sized.withColumn("long", F.when(long, 1).otherwise(0).cast("bigint"))
    sized = sized.withColumn("head_bytes", F.col("name_bytes") + LOCAL_HEADER + SIZES_EXTRA * F.col("long"))
    sized = sized.withColumn("local_bytes", F.col("packed_size") + F.col("head_bytes"))
    ordered = running_sums(
        sized,
        ["archive_path"],
        ["rank_group", "name"],
        {"entry_offset": "local_bytes", "entry_rank": "one", "names_before": "name_bytes", "long_before": "long"},
    )
    totals = sized.groupBy("archive_path").agg(
        F.sum("local_bytes").cast("bigint").alias("directory_start"),
        F.count(F.lit(1)).alias("entries"),
        F.sum("rank_group").cast("bigint").alias("file_count"),
        F.sum("name_bytes").cast("bigint").alias("all_names"),
        F.sum("long").cast("bigint").alias("all_long"),
    )
    far = F.col("directory_start") >= LIMIT_32
    per_entry = F.when(far, CENTRAL_HEADER + OFFSET_EXTRA).otherwise(CENTRAL_HEADER)
    # Both long sizes; an entry without a long offset has no head of its extra field otherwise.
    per_long = F.when(far, 16).otherwise(SIZES_EXTRA)
    size = per_entry * F.col("entries") + F.col("all_names") + per_long * F.col("all_long")
    totals = totals.withColumns({"far": far, "directory_size": size, "per_entry": per_entry, "per_long": per_long})
    end_at = F.col("directory_start") + F.col("directory_size")
    long_end = (F.col("entries") >= LIMIT_16) | far | (F.col("directory_size") >= LIMIT_32)
    totals = totals.withColumns(
        {
            "end_position": end_at,
            "parts": F.floor(end_at / part_bytes).cast("bigint") + 1,
            "archive_bytes": end_at + END_RECORD + F.when(long_end, LONG_END_RECORDS).otherwise(0),
        }
    ).drop("all_names", "all_long")
    placed = spread_join(ordered, totals, ["archive_path"], ["name"], "inner")
    common = [
        "archive_path", "name", "crc", "raw_size", "packed_size", "entry_offset", "file_count", "entries",
        "directory_start", "directory_size", "far", "parts", "archive_bytes",
    ]
    no_bytes = F.lit(None).cast("binary").alias("packed")
    local = placed.select(*common, F.lit(LOCAL).alias("section"), F.col("entry_offset").alias("position"), no_bytes)
    # A member's blocks are at most its size over block_bytes, and only their sizes are ordered.
    before = Window.partitionBy("archive_path", "name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    files = entries.where(~F.endswith("name", F.lit("/")))
    block_at = files.select(
        "archive_path", "name", "block", F.coalesce(F.sum("packed_size").over(before), F.lit(0)).cast("bigint").alias("packed_before")
    )
    starts = placed.select(*common, "head_bytes").join(block_at, ["archive_path", "name"])
    with_bytes = starts.join(files.select("archive_path", "name", "block", "packed"), ["archive_path", "name", "block"]).select(
        *common, F.lit(BLOCK).alias("section"), (F.col("entry_offset") + F.col("head_bytes") + F.col("packed_before")).alias("position"), "packed"
    )
    central_at = F.col("directory_start") + F.col("per_entry") * F.col("entry_rank") + F.col("names_before") + F.col("per_long") * F.col("long_before")
    central = placed.select(*common, F.lit(CENTRAL).alias("section"), central_at.alias("position"), no_bytes)
    blank = {"name": "string", "crc": "bigint", "raw_size": "bigint", "packed_size": "bigint", "entry_offset": "bigint"}
    end = totals.select(
        *[F.lit(None).cast(blank[c]).alias(c) if c in blank else F.col(c) for c in common],
        F.lit(END).alias("section"),
        F.col("end_position").alias("position"),
        no_bytes,
    )
    segments = (
        with_bytes.unionByName(local)
        .unionByName(central)
        .unionByName(end)
        .withColumn("part", F.least(F.floor(F.col("position") / part_bytes).cast("bigint"), F.col("parts") - 1))
    )
    encoded = segments.mapInArrow(_encoded, SEGMENT_SCHEMA)
    return encoded.groupBy("archive_path", "part").applyInArrow(_assemble, PART_SCHEMA)
