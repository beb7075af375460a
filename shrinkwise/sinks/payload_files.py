"""Writing payload bytes under an output root given as a path or URI that every executor can reach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.session import saved_table
from shrinkwise.sources.storage import below, open_root, pieces_of, replace_file

WRITTEN_SCHEMA = T.StructType(
    [
        T.StructField("output_path", T.StringType()),
        T.StructField("bytes_written", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
PART_WRITTEN_SCHEMA = T.StructType([*WRITTEN_SCHEMA.fields, T.StructField("start", T.LongType()), T.StructField("parts", T.LongType())])


def _reporting(schema: T.StructType, write: Callable[[dict], int], carried: tuple[str, ...] = ()):
    """Runs `write` on each row and reports its bytes or its error; one failing file does not fail the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                report = {"output_path": row["output_path"], "bytes_written": None, "error": None, **{c: row[c] for c in carried}}
                try:
                    report["bytes_written"] = write(row)
                except Exception as exc:  # noqa: BLE001 - reported in the row
                    report["error"] = f"{type(exc).__name__}: {exc}"
                rows.append(report)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return work


def write_payloads(
    df: DataFrame, out_root: str, path: str = "output_path", content: str = "content", source: str | None = None
) -> DataFrame:
    """Write each row's bytes to `out_root/path`; returns (output_path, bytes_written, error).

    With `source`, rows without bytes are copied from the path in that column, a few megabytes at a time, so files
    of any size are copied without becoming rows. `out_root` is a local or mounted path or a URI (file, hdfs, s3,
    gs); a URI whose scheme is unknown gives an error in every row and writes nothing. The returned frame must be
    consumed for the writes to happen; consuming it twice writes the same files twice.
    """

    def write(row: dict) -> int:
        where, base = open_root(out_root)
        copied = row["content"] is None and row["source"] is not None
        return replace_file(where, below(base, row["output_path"]), pieces_of(row["source"]) if copied else [row["content"] or b""])

    origin = F.col(source) if source else F.lit(None).cast("string")
    rows = df.select(F.col(path).alias("output_path"), F.col(content).alias("content"), origin.alias("source"))
    return rows.mapInArrow(_reporting(WRITTEN_SCHEMA, write), WRITTEN_SCHEMA)


def _part_folder(target: str) -> str:
    return f"{target}.parts"


def write_archive_parts(parts: DataFrame, out_root: str) -> DataFrame:
    """Write the output of pack_archives; returns a row per archive (output_path, bytes_written, error).

    All parts are written in parallel in one pass: an archive of one part to its place, others to a scratch folder
    beside it. An archive whose parts are all there is then joined by copying, a few megabytes at a time, and renamed,
    so its path never shows half an archive. The parts are written when this is called, the joins when the
    returned frame is consumed.
    """

    def write(row: dict) -> int:
        where, base = open_root(out_root)
        target = below(base, row["output_path"])
        if row["parts"] > 1:
            target = f"{_part_folder(target)}/{row['start']}"
        return replace_file(where, target, [row["content"]])

    def join(row: dict) -> int:
        if row["failed"]:
            raise OSError(row["failed"])
        where, base = open_root(out_root)
        target = below(base, row["output_path"])

        whole = (p for start in sorted(row["starts"]) for p in pieces_of(f"{_part_folder(below(out_root, row['output_path']))}/{start}"))
        size = replace_file(where, target, whole)
        where.delete_dir(_part_folder(target))
        return size

    rows = parts.select(F.col("archive_path").alias("output_path"), "content", "start", "parts")
    done = saved_table(rows.mapInArrow(_reporting(PART_WRITTEN_SCHEMA, write, ("start", "parts")), PART_WRITTEN_SCHEMA), "parts")
    single = done.where("parts = 1").select(*WRITTEN_SCHEMA.names)
    several = done.where("parts > 1").groupBy("output_path").agg(F.collect_list("start").alias("starts"), F.max("error").alias("failed"))
    return single.unionByName(several.mapInArrow(_reporting(WRITTEN_SCHEMA, join), WRITTEN_SCHEMA))
