"""Archive safety, quotas, expansion bookkeeping and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shrinkwise.config import Quota
from shrinkwise.operators.skew import HEAVY_ROWS, spread_join

# Unix file-type bits in the upper half of the external attributes.
FILE_TYPE_MASK = 0o170000
SYMLINK_TYPE = 0o120000

OVER_MEMBERS = "member_count"
OVER_BYTES = "total_size"


# ':' in the first path part, whatever './' stands before it.
DRIVE_PART = r"^(?:\./+)*[^/]*:"


def name_violation(name: Column | str) -> Column:
    """absolute_path, path_traversal, drive_path, or null for a safe member name.

    '\\' counts as '/'; empty and '.' parts are ignored. Plain string tests, so the check is compiled
    into the scan stage.
    """
    path = F.replace(F.col(name) if isinstance(name, str) else name, F.lit("\\"), F.lit("/"))
    return (
        F.when(F.startswith(path, F.lit("/")), "absolute_path")
        .when(F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit("/../")), "path_traversal")
        .when(F.contains(path, F.lit(":")) & path.rlike(DRIVE_PART), "drive_path")
    )


def is_symlink(external_attr: Column | str) -> Column:
    attr = F.col(external_attr) if isinstance(external_attr, str) else external_attr
    return F.shiftrightunsigned(attr.cast("bigint"), 16).bitwiseAND(F.lit(FILE_TYPE_MASK)) == SYMLINK_TYPE


def member_verdict(members: DataFrame) -> DataFrame:
    """Add `violation`: symlink first, then the name; null when the member is safe."""
    return members.withColumn(
        "violation", F.when(is_symlink("external_attr"), "symlink").otherwise(name_violation("name"))
    )


def archive_quota(members: DataFrame, quota: Quota = Quota()) -> DataFrame:
    """Member count and unpacked bytes per archive, and which limit they break, if any."""
    totals = members.groupBy("archive_path").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.sum(F.greatest(F.col("file_size"), F.lit(0))).cast("bigint").alias("total_bytes"),
    )
    return totals.withColumn(
        "quota_violation",
        F.when(F.col("member_count") > quota.max_members, OVER_MEMBERS).when(
            F.col("total_bytes") > quota.max_bytes, OVER_BYTES
        ),
    )


def first_violation(
    members: DataFrame,
    quota: Quota = Quota(),
    order_by: Sequence[str] = ("idx",),
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per archive: the first reason to reject it, in member order.

    Too many members rejects at once. Otherwise, member by member, the running size is checked
    before the symlink bit and the name. Only archives that exceed the byte limit need a running
    sum, and those have at most `quota.max_members` members, so every window is bounded whatever
    the largest archive in the data. Adds `violation` and `violating_member` (null when accepted).
    """
    totals = archive_quota(members, quota)
    position = F.struct(*order_by)
    unsafe = (
        member_verdict(members)
        .where(F.col("violation").isNotNull())
        .groupBy("archive_path")
        .agg(F.min(F.struct(position.alias("at"), "violation", "name")).alias("_unsafe"))
    )
    counts = totals.select("archive_path", F.col("member_count").alias("_rows"), "total_bytes", "quota_violation")
    suspects = counts.where(F.col("quota_violation") == OVER_BYTES).select("archive_path", "_rows")
    run = Window.partitionBy("archive_path").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    # Reading both totals keeps this plan equal to the others over `totals`, so its shuffle is reused.
    counts = counts.where(F.col("total_bytes").isNotNull())
    over = (
        spread_join(members, suspects, ["archive_path"], list(order_by), "left_semi", heavy_rows, counts)
        .withColumn("_running", F.sum(F.greatest(F.col("file_size"), F.lit(0))).over(run))
        .where(F.col("_running") > quota.max_bytes)
        .groupBy("archive_path")
        .agg(F.min(F.struct(position.alias("at"), "name")).alias("_over"))
    )
    too_many = F.col("quota_violation") == OVER_MEMBERS
    over_first = F.col("_over").isNotNull() & (
        F.col("_unsafe").isNull() | (F.col("_over.at") <= F.col("_unsafe.at"))
    )
    return (
        totals.join(unsafe, "archive_path", "left")
        .join(over, "archive_path", "left")
        .select(
            "archive_path",
            "member_count",
            "total_bytes",
            F.when(too_many, OVER_MEMBERS)
            .when(over_first, OVER_BYTES)
            .otherwise(F.col("_unsafe.violation"))
            .alias("violation"),
            F.when(too_many, F.lit(None).cast("string"))
            .when(over_first, F.col("_over.name"))
            .otherwise(F.col("_unsafe.name"))
            .alias("violating_member"),
        )
    )


def archive_outcomes(checked: DataFrame, violation: str = "violation") -> DataFrame:
    """One row: archives extracted and failed, members extracted, and none / partial / ok."""
    ok = F.col(violation).isNull()
    counts = checked.agg(
        F.count_if(ok).alias("extracted"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("member_count"))), F.lit(0)).cast("bigint").alias("members_extracted"),
    )
    result = (
        F.when((F.col("extracted") == 0) & (F.col("failed") == 0), "none")
        .when(F.col("failed") > 0, "partial")
        .otherwise("ok")
    )
    return counts.withColumn("result", result)


def unprocessed(archives: DataFrame, seen: DataFrame, path: str = "archive_path") -> DataFrame:
    """Archives no earlier sweep has handled. Each side is reduced to its paths before the join."""
    return archives.join(seen.select(path).distinct(), path, "left_anti")


def repack_candidates(archives: DataFrame, outputs: DataFrame, path: str = "archive_path") -> DataFrame:
    """Archives with at least one output file; duplicates are removed before the join."""
    return archives.join(outputs.select(path).distinct(), path, "left_semi")
