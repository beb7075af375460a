"""Job monitoring and folder intake as Structured Streaming. Each transformation also runs on batch frames."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shrinkwise.functions.paths import file_extension
from shrinkwise.operators.accounting import progress_percent
from shrinkwise.sources.scan import ARCHIVE_GLOB, BINARY_FILE_SCHEMA

# Fixed value: label key shown when a job reported an error.
STATUS_FAILED = "status_failed_see_log"
#: Spark's setting for the most tasks that look at the paths of one read.
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _zero(name: str):
    return F.coalesce(F.col(name), F.lit(0))


def dispatch_events(events: DataFrame) -> DataFrame:
    """Route events by kind to the targets log, progress, stats and status.

    Missing numbers count as zero. Text events without a message are dropped; an error writes its
    message to the log and sets the failed status, so it becomes two rows.
    """
    kind = F.col("kind")
    has_text = F.col("message").isNotNull()
    targets = (
        F.when(kind.isin("log", "status") & has_text, F.array(kind))
        .when(kind.isin("progress", "stats"), F.array(kind))
        .when((kind == "error") & has_text, F.array(F.lit("log"), F.lit("status")))
        .otherwise(F.array().cast("array<string>"))
    )
    routed = events.withColumn("target", F.explode(targets))
    target = F.col("target")
    text = (
        F.when((kind == "error") & (target == "status"), STATUS_FAILED)
        .when(target.isin("log", "status"), F.col("message"))
    )
    on_progress, on_stats = target == "progress", target == "stats"
    return routed.select(
        "job_id",
        "ts",
        "kind",
        "target",
        text.alias("text"),
        F.when(on_progress, _zero("current")).alias("current"),
        F.when(on_progress, _zero("total")).alias("total"),
        F.when(on_progress, progress_percent(_zero("current"), _zero("total"))).alias("pct"),
        *[F.when(on_stats, _zero(c)).alias(c) for c in ("orig_total", "out_total", "saved", "saved_pct")],
    )


def job_state(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """Running state per job: files done, byte totals, latest status text, errors seen."""
    kind = F.col("kind")
    status_at = F.when((kind == "status") & F.col("message").isNotNull(), F.struct("ts", tie))
    return events.groupBy("job_id").agg(
        F.count_if(kind == "progress").alias("files_done"),
        F.coalesce(F.sum(F.when(kind == "stats", F.col("orig_total"))), F.lit(0)).cast("bigint").alias("orig_total"),
        F.coalesce(F.sum(F.when(kind == "stats", F.col("out_total"))), F.lit(0)).cast("bigint").alias("out_total"),
        F.max_by("message", status_at).alias("latest_status"),
        F.count_if(kind == "error").alias("errors"),
    )


def once_per_path(df: DataFrame, watermark: str | None = "7 days", path: str = "path", ts: str = "ts") -> DataFrame:
    """First sight of each path. Remembered paths expire after the watermark; with None they are kept for as long
    as the stream lives, and so is its state."""
    if watermark is None:
        return df.dropDuplicates([path])
    return df.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([path])


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """File streams that run inside ask about a batch's files in a few tasks for each core.

    Spark looks at every new file once more by its path, in a task each up to 10,000, which takes longer than reading
    small files does. It follows the session whose reader made the stream, while the stream runs.
    """
    before = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(LISTING_TASKS, before)


def watch_folder(
    spark: SparkSession, root: str, archives_only: bool = False, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of new files below `root`: path, name-based ext, size, modified, content.

    Run it within few_listing_tasks where a batch may hold many files.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("recursiveFileLookup", "true")
    )
    if archives_only:
        reader = reader.option("pathGlobFilter", ARCHIVE_GLOB)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    files = reader.load(root)
    return files.select(
        "path",
        file_extension("path").alias("ext"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
        "content",
    )


def on_batch(
    stream: DataFrame,
    callback: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = True,
    mode: str = "append",
) -> StreamingQuery:
    """Hand every micro-batch to `callback(frame, batch_id)`; retries repeat the same batch id."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(callback)
    return (writer.trigger(availableNow=True) if once else writer).start()


def by_target(callbacks: Mapping[str, Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """A batch callback giving each target's rows of dispatch_events to its own callback, as a frame."""

    def deliver(frame: DataFrame, batch_id: int) -> None:
        frame.persist()
        try:
            for target, callback in callbacks.items():
                callback(frame.where(F.col("target") == target), batch_id)
        finally:
            frame.unpersist()

    return deliver


def observed(results: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """Count files and bytes while the frame is computed for something else; read `.get` afterwards."""
    observation = Observation(name)
    metrics = [
        F.count(F.lit(1)).alias("files_done"),
        F.coalesce(F.sum("orig_size"), F.lit(0)).alias("orig_total"),
        F.coalesce(F.sum("out_size"), F.lit(0)).alias("out_total"),
    ]
    return results.observe(observation, *metrics), observation


def publish_state(states: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the changes of a running aggregate as a table: each micro-batch rewrites its own folder,
    so a repeated batch changes nothing and no state passes through the driver."""

    def save(frame: DataFrame, batch_id: int) -> None:
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return on_batch(states, save, checkpoint, once, "update")


def latest_state(spark: SparkSession, out: str, key: str = "job_id") -> DataFrame:
    """The last published row of each key, by one aggregation that shrinks the history before it is shuffled."""
    history = spark.read.parquet(out)
    columns = [c for c in history.columns if c != "batch"]
    last = history.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_last"))
    return last.select("_last.*")


def compact_state(spark: SparkSession, out: str, key: str = "job_id") -> None:
    """Fold all batches but the last into the one before it, in place; the stream goes on with the same checkpoint.

    For the time between two runs of the stream. The last batch is left alone, as a stream that was stopped in it writes it anew.
    Rows of keys that the batch before it lacks are added to that one, then older batches go; if this ends
    halfway, nothing is lost, as every older row is still there or stands in the newer batch.
    """
    *older, last = sorted(r[0] for r in spark.read.parquet(out).select("batch").distinct().collect())
    if len(older) < 2:
        return
    history = spark.read.parquet(out).where(F.col("batch") < last)
    columns = [c for c in history.columns if c != "batch"]
    newest = history.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_last"), F.max("batch").alias("_batch"))
    scratch, into = f"{out}/_compacted-{uuid.uuid4().hex}", f"{out}/batch={older[-1]}"
    newest.where(F.col("_batch") < older[-1]).select("_last.*").write.parquet(scratch)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in files.listStatus(path(scratch)):
        if part.getPath().getName().startswith("part-"):
            files.rename(part.getPath(), path(into))
    for batch in older[:-1]:
        files.delete(path(f"{out}/batch={batch}"), True)
    files.delete(path(scratch), True)
