"""Large members deflated as independent blocks by many tasks.

Each block ends on a byte boundary and refers to nothing before it, so blocks joined in order are one deflate stream.
The checksum of a whole member is the exclusive-or of its blocks' checksums, each moved over the bytes behind it, and
so an aggregation in any order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.operators.balance import by_bytes, payload_slices
from shrinkwise.sources.storage import RangedFile

BLOCK_BYTES = 16 * 1024 * 1024

# Fixed value: the polynomial of CRC-32, lowest powers in the highest bits.
POLYNOMIAL = 0xEDB88320

BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("crc", T.LongType()),
        T.StructField("raw_size", T.LongType()),
        T.StructField("packed_size", T.LongType()),
        T.StructField("packed", T.BinaryType()),
    ]
)


def _product(a: int, b: int) -> int:
    """Product of two polynomials over the field of two elements, modulo that of CRC-32."""
    result = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            result ^= b
        b = (b >> 1) ^ (POLYNOMIAL if b & 1 else 0)
    return result


def moved_crc(crc: int, behind: int) -> int:
    """What a stretch with this CRC-32 adds to the CRC-32 of a text that has `behind` more bytes after it."""
    factor, square = 1 << 31, 1 << 23
    while behind:
        if behind & 1:
            factor = _product(factor, square)
        square = _product(square, square)
        behind >>= 1
    return _product(factor, crc)


def deflated_block(data: bytes, last: bool) -> bytes:
    deflater = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -zlib.MAX_WBITS)
    return deflater.compress(data) + deflater.flush(zlib.Z_FINISH if last else zlib.Z_SYNC_FLUSH)


def _block_row(archive: str, name: str, number: int, data: bytes, behind: int) -> dict[str, object]:
    packed = deflated_block(data, behind == 0)
    return {
        "archive_path": archive, "name": name, "block": number, "crc": moved_crc(zlib.crc32(data), behind),
        "raw_size": len(data), "packed_size": len(packed), "packed": packed,
    }


def _batch(row: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([row], schema=to_arrow_schema(BLOCK_SCHEMA))


def content_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of files whose bytes are in their rows (archive_path, name, content); null is empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in payload_slices(batches, 2):
            rows = []
            for archive, name, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                data = blob.as_py() or b""
                for number, start in enumerate(range(0, max(len(data), 1), block_bytes)):
                    piece = data[start : start + block_bytes]
                    rows.append(_block_row(archive.as_py(), name.as_py(), number, piece, len(data) - start - len(piece)))
            yield pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(BLOCK_SCHEMA))

    return files.select("archive_path", "name", "content").mapInArrow(work, BLOCK_SCHEMA)


def source_blocks(files: DataFrame, block_bytes: int = BLOCK_BYTES, task_bytes: int | None = None) -> DataFrame:
    """Blocks of files that are read from their `source` by ranges (archive_path, name, source, size).

    The blocks of one file are dealt to as many tasks as its bytes need, `task_bytes` each or those of `by_bytes`. A file
    shorter than its `size` fails the task, so no archive holds a file that changed while it was read.
    """
    number_of = F.greatest(F.ceil(F.col("size") / F.lit(block_bytes)).cast("bigint"), F.lit(1).cast("bigint"))
    blocks = files.select("archive_path", "name", "source", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), number_of - 1)).alias("block"))
    blocks = blocks.withColumn("length", F.least(F.lit(block_bytes).cast("bigint"), F.col("size") - F.col("block") * block_bytes))
    dealt = by_bytes(blocks, "length", ("source", "block"), **({"target": task_bytes} if task_bytes else {}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                start = row["block"] * block_bytes
                with RangedFile(row["source"]) as file:
                    data = file.read_at(start, row["length"])
                if len(data) != row["length"]:
                    raise OSError(f"{row['source']} is shorter than its {row['size']} bytes")
                yield _batch(_block_row(row["archive_path"], row["name"], row["block"], data, row["size"] - start - len(data)))

    return dealt.mapInArrow(work, BLOCK_SCHEMA)


def whole_members(blocks: DataFrame) -> DataFrame:
    """Checksum and sizes of every member, from its blocks: (archive_path, name, crc, raw_size, packed_size)."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("raw_size", "packed_size")]
    return blocks.groupBy("archive_path", "name").agg(F.bit_xor("crc").alias("crc"), *sums)
