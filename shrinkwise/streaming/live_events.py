"""Events of a job while it runs: tasks write them as files finish, a stream or a batch reads them."""

from __future__ import annotations

import posixpath
import uuid
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.functions.scalars import saved_bytes, saved_pct
from shrinkwise.operators.messages import result_messages
from shrinkwise.sources.storage import open_root

#: What tasks write for every file that is done.
DONE = pa.schema(
    [
        ("job_id", pa.string()), ("task_id", pa.string()), ("finished_at", pa.timestamp("us")), ("ok", pa.bool_()),
        ("orig_size", pa.int64()), ("out_size", pa.int64()), ("error", pa.string()),
    ]
)
DONE_DDL = "job_id string, task_id string, finished_at timestamp_ntz, ok boolean, orig_size bigint, out_size bigint, error string"


class DoneLog:
    """Called in tasks with rows that are done; each call leaves one small file, which is never seen half-written."""

    def __init__(self, folder: str, job_id: str):
        self.folder, self.job_id = folder, job_id

    def __call__(self, rows: list[dict[str, object]]) -> None:
        where, base = open_root(self.folder)
        where.create_dir(base, recursive=True)
        name = f"{datetime.now():%Y%m%d%H%M%S}-{uuid.uuid4().hex}.parquet"
        scratch = posixpath.join(base, f"_{name}")
        pq.write_table(pa.Table.from_pylist([{**r, "job_id": self.job_id} for r in rows], schema=DONE), scratch, filesystem=where)
        where.move(scratch, posixpath.join(base, name))


def watch_done(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of the files that are done in the jobs that log into a folder, as they finish."""
    return spark.readStream.schema(DONE_DDL).parquet(folder)


def read_done(spark: SparkSession, folder: str, results: DataFrame | None = None, task: str = "audit_input") -> DataFrame:
    """What has been logged so far. With the results of the finished job, only what committed attempts logged: a task that
    was lost and run again has logged its files twice, at different times, and results hold the time that counts."""
    logged = spark.read.schema(DONE_DDL).parquet(folder)
    if results is None:
        return logged
    counted = results.select(F.col(task).alias("task_id"), "finished_at")
    return logged.join(counted, ["task_id", "finished_at"], "left_semi").select(*logged.columns)


def done_events(done: DataFrame, labels: DataFrame | None = None, lang: str = "en") -> DataFrame:
    """Events as dispatch_events and job_state read them, of a batch or a stream of files that are done.

    A file is a progress event; if its transform ran, a log event with its text, or an error event with what went wrong; and if
    it succeeded, its sizes. event_id names file and kind, so that a stream can drop repetitions (once_per_event).
    With a catalog, texts are in the given language.
    """
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    if labels is not None:
        done = result_messages(done, labels, lang, base=F.col("task_id"))
    else:
        done = done.withColumn("message", F.col("task_id"))
    text = F.when(failed, F.concat_ws(": ", "task_id", "error")).otherwise(F.col("message"))
    kinds = F.array_compact(F.array(F.lit("progress"), F.when(failed, "error").otherwise("log"), F.when(F.col("ok"), "stats")))
    each = done.withColumns({"text": text, "kind": F.explode(kinds)})
    stats = F.col("kind") == "stats"
    out = F.coalesce("out_size", "orig_size")
    return each.select(
        "job_id", F.col("finished_at").cast("timestamp").alias("ts"), F.concat_ws(" ", "kind", "task_id").alias("event_id"), "kind",
        F.when(~F.col("kind").isin("progress", "stats"), F.col("text")).alias("message"),
        F.lit(None).cast("bigint").alias("current"), F.lit(None).cast("bigint").alias("total"),
        F.when(stats, F.col("orig_size")).alias("orig_total"), F.when(stats, out).alias("out_total"),
        F.when(stats, saved_bytes("orig_size", out)).alias("saved"), F.when(stats, saved_pct("orig_size", out)).alias("saved_pct"),
    )


def once_per_event(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events of a stream without repetitions by tasks that were run again; ids are kept for the time of the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["job_id", "event_id"])
