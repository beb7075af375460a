"""Savings, totals, task lookup and progress counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shrinkwise.functions.scalars import saved_bytes, saved_pct
from shrinkwise.operators.skew import HEAVY_ROWS, spread_join
from shrinkwise.session import pinned


def with_savings(df: DataFrame, orig: str = "orig_size", out: str = "out_size") -> DataFrame:
    """Missing outputs count as unchanged; adds saved_bytes and saved_pct."""
    return df.withColumn(out, F.coalesce(F.col(out), F.col(orig))).withColumns(
        {"saved_bytes": saved_bytes(orig, out), "saved_pct": saved_pct(orig, out)}
    )


def attach_tasks(
    results: DataFrame, tasks: DataFrame, key: str = "task_id", heavy_rows: int = HEAVY_ROWS
) -> DataFrame:
    """Results produced elsewhere, joined back to the task that asked for them.

    Task ids are unique on the task side; several results may answer the same task.
    """
    spread = [c for c in results.columns if c != key]
    return spread_join(results, tasks, [key], spread, "inner", heavy_rows)


def job_totals(
    df: DataFrame,
    by: Sequence[str] = (),
    processed: str = "processed",
    orig: str = "orig_size",
    out: str = "out_size",
) -> DataFrame:
    """Totals over processed rows only; without `by` always exactly one row, zeros for no input."""
    totals = (
        df.where(F.col(processed))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("processed_files"),
            F.coalesce(F.sum(orig), F.lit(0)).cast("bigint").alias("orig_total"),
            F.coalesce(F.sum(F.coalesce(F.col(out), F.col(orig))), F.lit(0)).cast("bigint").alias("out_total"),
        )
    )
    return totals.withColumns(
        {"saved": saved_bytes("orig_total", "out_total"), "saved_pct": saved_pct("orig_total", "out_total")}
    )


def progress_percent(current, total):
    return F.when(total > 0, (current / total * 100).cast("int")).otherwise(100)


def progress(df: DataFrame, job: str = "job_id", finished_at: str = "finished_at", task: str = "task_id") -> DataFrame:
    """Number every finished task within its job: current, total, pct.

    A job may hold most of the rows, all at one instant. Rows are range-partitioned on job, time and task into
    slices, pinned by a reliable checkpoint; ranks are taken inside (job, slice) and shifted by the counts of
    the job's earlier slices. Jobs, times and tasks may be null; nulls come first.
    """
    sliced = pinned(df.repartitionByRange(job, finished_at, task).withColumn("_slice", F.spark_partition_id()))
    keys = F.struct(job, "_slice")
    per_job = Window.partitionBy(job)
    earlier = per_job.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy(job, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        keys.alias("_keys"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(per_job).alias("total")
    )
    rank = F.row_number().over(Window.partitionBy(job, "_slice").orderBy(finished_at, task))
    ranked = sliced.withColumns({"_rank": rank, "_keys": keys}).join(counts, "_keys")
    return (
        ranked.withColumn("current", (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .withColumn("pct", progress_percent(F.col("current"), F.col("total")))
        .select(*df.columns, "current", "total", "pct")
    )
