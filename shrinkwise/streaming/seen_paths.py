"""Paths that a stream has seen, as state that expires; changed files are let in again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs before a stream with admit_paths is started.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class SeenPaths(StatefulProcessor):
    """Remembers of every path the newest change it has let through."""

    def __init__(self, path: str, changed: str, ttl_ms: int):
        self.path, self.changed, self.ttl_ms = path, changed, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("changed", T.LongType())]), ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # Each call of the state is a message to the JVM and back: one to read it, one to change it.
        known = self.seen.get()
        last = known[0] if known is not None else None
        # Of one micro-batch only the newest change counts.
        newest = max(row[self.changed] for row in rows)
        if last is None or newest > last:
            self.seen.update((newest,))
            yield Row(**{self.path: key[0], self.changed: newest})

    def close(self) -> None:
        pass


def admit_paths(stream: DataFrame, path: str = "path", modified: str | None = "modified", ttl: str = "7 days") -> DataFrame:
    """(path, modified): every path once, and again when a later `modified` comes; of several in one batch the newest.

    State is one number per path in RocksDB, and goes `ttl` (processing time) after the path was last let in, so it is bounded by the
    paths of that time, whatever the stream has seen before. Without `modified` a path is let in again only
    after it has expired, and modified is null. Sets the session's state store, and turns off batches without data, of which
    a stream with such state would run ever more after all data is read (SETTINGS).
    """
    spark = stream.sparkSession
    for setting, value in SETTINGS.items():
        spark.conf.set(setting, value)
    ttl_ms = int(spark.sql(f"SELECT unix_millis(TIMESTAMP '1970-01-01 00:00:00 UTC' + INTERVAL {ttl})").first()[0])
    changed = F.unix_micros(F.col(modified).cast("timestamp")) if modified else F.lit(0).cast("bigint")
    rows = stream.select(F.col(path).alias("path"), F.coalesce(changed, F.lit(0)).alias("changed")).where("path is not null")
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("changed", T.LongType())])
    admitted = rows.groupBy("path").transformWithState(SeenPaths("path", "changed", ttl_ms), schema, "append", "ProcessingTime")
    back = F.timestamp_micros("changed") if modified else F.lit(None).cast("timestamp")
    return admitted.select(F.col("path").alias(path), back.alias(modified or "modified"))
