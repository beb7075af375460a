"""Cleanup plans, snapshot selection and tree comparison. Nothing here deletes files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.functions.paths import ancestor_dirs
from shrinkwise.operators.routing import in_extensions, with_extensions


def count_targets(df: DataFrame, exts: Iterable[str]) -> DataFrame:
    """One row: how many files have one of the types (an empty set counts nothing)."""
    return with_extensions(df, exts).agg(F.count(F.lit(1)).alias("target_files"))


@dataclass(frozen=True)
class CleanupPlan:
    """`files` with a `deleted` flag, one-row `counts`, and `emptied_dirs` deepest first."""

    files: DataFrame
    counts: DataFrame
    emptied_dirs: DataFrame


def dir_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def emptied_dirs(files: DataFrame, path: str = "rel_path", deleted: str = "deleted") -> DataFrame:
    """Folders in which no file survives, deepest first.

    One aggregation over (folder, survived): partial sums shrink the rows of a popular folder
    before they are shuffled. Folders that never held a file are not visible here.
    """
    return (
        files.select(F.explode(ancestor_dirs(path)).alias("dir"), (~F.col(deleted)).alias("survives"))
        .groupBy("dir")
        .agg(F.max("survives").alias("any_left"))
        .where(~F.col("any_left"))
        .select("dir", dir_depth(F.col("dir")).alias("depth"))
        .orderBy(F.desc("depth"), "dir")
    )


def plan_cleanup(
    df: DataFrame, exts: Iterable[str] = (), path: str = "rel_path", ext: str = "ext"
) -> CleanupPlan:
    """Files of the given types are removed (an empty set means all), then folders left empty."""
    exts = list(exts)
    files = df.withColumn("deleted", in_extensions(ext, exts) if exts else F.lit(True))
    counts = files.agg(
        F.count_if("deleted").alias("deleted_count"),
        F.count_if(~F.col("deleted")).alias("skipped_count"),
    )
    return CleanupPlan(files, counts, emptied_dirs(files, path))


def snapshot_select(df: DataFrame, path: str = "path", position: str = "position") -> DataFrame:
    """Paths worth keeping: no blanks, nothing in dist, first of each path whatever its case."""
    p = F.col(path)
    wanted = (F.trim(p) != "") & (F.lower(p) != "dist") & ~F.startswith(p, F.lit("dist/"))
    return (
        df.where(wanted)
        .groupBy(F.lower(p).alias("path_key"))
        .agg(F.min(position).alias(position), F.min_by(path, position).alias(path))
        .select(position, path)
    )


def tree_diff(before: DataFrame, after: DataFrame, path: str = "rel_path", size: str = "size") -> DataFrame:
    """Paths added, removed or resized between two snapshots; no rows means unchanged.

    Both trees meet in one aggregation by path, so neither is sorted or broadcast. A path is there if it has a
    row, whatever its size; unknown sizes are equal to each other and to nothing else.
    """

    def side(df: DataFrame, name: str, other: str) -> DataFrame:
        known = {f"{name}_size": F.col(size).cast("bigint"), f"in_{name}": F.lit(True)}
        blank = {f"{other}_size": F.lit(None).cast("bigint"), f"in_{other}": F.lit(False)}
        return df.select(path, *[c.alias(n) for n, c in (known | blank).items()])

    sides = side(before, "before", "after").unionByName(side(after, "after", "before"))
    change = (
        F.when(~F.col("in_before"), "added")
        .when(~F.col("in_after"), "removed")
        .when(~F.col("before_size").eqNullSafe(F.col("after_size")), "resized")
    )
    return (
        sides.groupBy(path)
        .agg(*[F.max(c).alias(c) for c in ("before_size", "after_size", "in_before", "in_after")])
        .withColumn("change", change)
        .where(F.col("change").isNotNull())
        .drop("in_before", "in_after")
    )
