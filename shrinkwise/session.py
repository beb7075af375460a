"""Session settings and the shared folder used to cut lineage or keep intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Payload rows are large: bound what one Arrow batch may hold by bytes, not only by rows.
PAYLOAD_BATCH_CONF = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}

#: Spark's setting by which the shuffle files of a query go when it ends, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the library expects; deployment sizing (executors, memory) stays outside."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Plans here are built from many small expressions; recording a call site for each is slow.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **PAYLOAD_BATCH_CONF,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def local_session(cores: int = 8, app: str = "shrinkwise") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a private one only for local sessions without it."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="shrinkwise-")
        sc.setCheckpointDir(configured)
    return (configured or sc.getCheckpointDir()).rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/shrinkwise/{spark.sparkContext.applicationId}"


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def clear_tables(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application from the shared folder.

    For the end of a job: frames and reports that read those tables can no longer be computed afterwards.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later reads see exactly these rows even after executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files: what they wrote is all that is read of them later."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def saved_table(df: DataFrame, label: str) -> DataFrame:
    """Write once as Parquet in the shared folder and read back, so columns can still be pruned."""
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
