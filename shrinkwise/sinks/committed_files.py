"""Payload files in two phases: tasks write beside the target, and nothing is moved there before all have succeeded."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from shrinkwise.session import saved_table
from shrinkwise.sinks.payload_files import WRITTEN_SCHEMA
from shrinkwise.sources.storage import below, open_root, pieces_of

STAGED_FORMAT = "staged_files"
STAGED_SCHEMA = StructType([StructField("output_path", StringType()), StructField("content", BinaryType()), StructField("source", StringType())])
MANIFEST = pa.schema([("output_path", pa.string()), ("staged", pa.string()), ("bytes_written", pa.int64())])
#: Named by the commit: which attempts count. What other attempts left behind is never moved.
COMMITTED = "committed.parquet"


@dataclass
class Attempt(WriterCommitMessage):
    """A task's successful attempt; its files are listed in its own manifest."""

    name: str


#: How often, and every how many seconds, a folder is removed again into which tasks are still writing.
ABORT_TRIES, ABORT_PAUSE = 50, 0.1


class StagedWriter(DataSourceArrowWriter):
    """Each attempt writes into a folder of its own and lists what it wrote; the commit lists the attempts.

    Only the driver makes the staging folder. Tasks that still run when the write is given up make folders below it alone, so
    they cannot bring it back; where a file system makes folders unasked, what they write then stays in the staging folder.
    """

    def __init__(self, root: str, staging: str):
        self.root, self.staging = root, staging

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        where, base = open_root(self.staging)
        attempt, n = uuid.uuid4().hex, 0
        rows: list[dict] = []
        where.create_dir(posixpath.join(base, attempt), recursive=False)
        with where.open_output_stream(posixpath.join(base, "manifests", f"{attempt}.parquet")) as out, pq.ParquetWriter(out, MANIFEST) as manifest:
            for batch in iterator:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1).to_pylist()[0]
                    below(self.root, row["output_path"])
                    staged, n = f"{attempt}/{n}", n + 1
                    copied = row["content"] is None and row["source"] is not None
                    size = 0
                    with where.open_output_stream(posixpath.join(base, staged)) as file:
                        for piece in pieces_of(row["source"]) if copied else [row["content"] or b""]:
                            file.write(piece)
                            size += len(piece)
                    rows.append({"output_path": row["output_path"], "staged": staged, "bytes_written": size})
                manifest.write_batch(pa.RecordBatch.from_pylist(rows, schema=MANIFEST))
                rows.clear()
        return Attempt(attempt)

    def commit(self, messages: list[Attempt | None]) -> None:
        where, base = open_root(self.staging)
        where.create_dir(base, recursive=True)
        names = pa.table({"attempt": pa.array([m.name for m in messages if m is not None], pa.string())})
        # The rename is the commit: from then on the files count, and moving them can be begun again.
        scratch = posixpath.join(base, f"{COMMITTED}.part")
        pq.write_table(names, scratch, filesystem=where)
        where.move(scratch, posixpath.join(base, COMMITTED))

    def abort(self, messages: list[Attempt | None]) -> None:
        where, base = open_root(self.staging)
        for left in reversed(range(ABORT_TRIES)):
            if where.get_file_info(base).type == fs.FileType.NotFound:
                return
            try:
                where.delete_dir(base)
            except OSError:
                if not left:
                    raise
                time.sleep(ABORT_PAUSE)


class StagedFiles(DataSource):
    """df.write.format("staged_files"): rows (output_path, content, source) as files in a staging folder."""

    @classmethod
    def name(cls) -> str:
        return STAGED_FORMAT

    def schema(self) -> StructType:
        return STAGED_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        where, base = open_root(self.options["staging"])
        where.create_dir(posixpath.join(base, "manifests"), recursive=True)
        return StagedWriter(self.options["root"], self.options["staging"])


def write_committed(
    df: DataFrame, out_root: str, path: str = "output_path", content: str = "content", source: str | None = None, staging: str | None = None
) -> DataFrame:
    """Write each row's bytes, or a copy of its source, to `out_root/path`; returns (output_path, bytes_written, error).

    All or nothing: tasks write into a staging folder, by default a hidden one inside `out_root`, so that moving a file is a
    rename. If any row fails, the job fails, the staging folder is removed, and the target is as it was. When all
    tasks have succeeded, one record names the attempts that count, and their files are moved by tasks. That is done when this
    returns; publish_committed does it again for a staging folder that was committed but not moved to the end.
    """
    staging = staging or f"{out_root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
    df.sparkSession.dataSource.register(StagedFiles)
    origin = F.col(source) if source else F.lit(None).cast("string")
    rows = df.select(F.col(path).alias("output_path"), F.col(content).alias("content"), origin.alias("source"))
    rows.write.format(STAGED_FORMAT).options(root=out_root, staging=staging).mode("append").save()
    return publish_committed(df.sparkSession, out_root, staging)


def publish_committed(spark: SparkSession, out_root: str, staging: str) -> DataFrame:
    """Moves the files of a committed staging folder to their places, then removes the folder. Files that are there already stay."""
    attempts = spark.read.schema("attempt string").parquet(f"{staging}/{COMMITTED}")
    manifests = spark.read.schema("output_path string, staged string, bytes_written bigint").parquet(f"{staging}/manifests")
    listed = manifests.withColumn("attempt", F.substring_index("staged", "/", 1)).join(attempts, "attempt", "left_semi").drop("attempt")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        where, base = open_root(out_root)
        _, from_base = open_root(staging)
        for batch in batches:
            for row in batch.to_pylist():
                staged, target = posixpath.join(from_base, row["staged"]), below(base, row["output_path"])
                where.create_dir(posixpath.dirname(target), recursive=True)
                if where.get_file_info(staged).type != fs.FileType.NotFound:
                    where.move(staged, target)
            columns = [batch.column("output_path"), batch.column("bytes_written"), pa.nulls(batch.num_rows, pa.string())]
            yield pa.record_batch(columns, schema=to_arrow_schema(WRITTEN_SCHEMA))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = saved_table(listed.repartition(tasks, "staged").mapInArrow(move, WRITTEN_SCHEMA), "published")
    where, base = open_root(staging)
    where.delete_dir(base)
    return done
