"""Folder trees compared by digests: what lies below equal folders is never looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.functions.paths import ancestor_dirs, parent_dir
from shrinkwise.operators.cleanup import tree_diff
from shrinkwise.session import saved_table

DIGEST = "struct<files:bigint,mixed:bigint,total:decimal(38,0)>"


def _folded(rows: DataFrame, mixed: Column, total: Column, files: Column) -> list[Column]:
    return [F.sum(files).alias("files"), F.bit_xor(mixed).alias("mixed"), F.sum(total).cast("decimal(38,0)").alias("total")]


def folder_digests(tree: DataFrame, path: str = "rel_path", size: str = "size") -> DataFrame:
    """(folder, parent, depth, own, below): digests of a folder's own files and of all below it; the root is "".

    Files are first folded into their folders, then each folder's digest into those above it, level by level, so a file is
    shuffled once however deep it lies. A digest counts files and folds two hashes of path and size, one by exclusive-or and
    one by a sum; neither depends on an order, so a folder of any size is folded in parts. Save the result to compare
    a later state with it without listing the earlier one again.
    """
    hashed = F.struct(F.col(path), F.coalesce(F.col(size).cast("string"), F.lit("?")))
    named = tree.select(parent_dir(path).alias("folder"), F.xxhash64(hashed).alias("mixed"), F.xxhash64(F.lit(1), hashed).alias("total"))
    own = named.groupBy("folder").agg(*_folded(named, F.col("mixed"), F.col("total").cast("decimal(38,0)"), F.lit(1)))
    own = own.select("folder", F.struct("files", "mixed", "total").cast(DIGEST).alias("own"))
    # Every folder and all above it: the folder itself is the last of the folders above anything in it.
    above = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), ancestor_dirs(F.concat("folder", F.lit("/x")))))
    spread = own.select(F.explode(above).alias("at"), "folder", "own")
    below = spread.groupBy("at").agg(
        *_folded(spread, F.col("own.mixed"), F.col("own.total"), F.col("own.files")),
        F.max(F.when(F.col("at") == F.col("folder"), F.col("own"))).alias("own"),
    )
    depth = F.when(F.col("at") == "", 0).otherwise(F.size(F.split("at", "/")))
    parent = F.when(F.col("at") == "", F.lit(None)).when(F.contains("at", F.lit("/")), F.regexp_replace("at", "/[^/]*$", "")).otherwise("")
    return below.select(F.col("at").alias("folder"), parent.alias("parent"), depth.alias("depth"), "own", F.struct("files", "mixed", "total").cast(DIGEST).alias("below"))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """(folder, depth, own_differs): folders below which something differs between two results of folder_digests.

    Goes down level by level from the root; of each level only the folders in changed ones are looked at, so nothing
    below two equal folders is. Both inputs should be saved tables; one job runs for each level that has changes.
    """
    spark, found = before.sparkSession, None
    frontier, depth = spark.createDataFrame([("",)], "parent string"), 0
    while True:
        sides = []
        for name, digests in (("before", before), ("after", after)):
            level = digests.where(F.col("depth") == depth).withColumn("parent", F.coalesce("parent", F.lit("")))
            sides.append(level.join(frontier, "parent", "left_semi").select("folder", *[F.col(c).alias(f"{name}_{c}") for c in ("own", "below")]))
        met = sides[0].join(sides[1], "folder", "full_outer").where(~F.col("before_below").eqNullSafe(F.col("after_below")))
        own_differs = ~F.col("before_own").eqNullSafe(F.col("after_own"))
        level = saved_table(met.select("folder", F.lit(depth).alias("depth"), own_differs.alias("own_differs")), "changed")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            return found
        frontier, depth = level.select(F.col("folder").alias("parent")), depth + 1


def tree_diff_by_folders(before: DataFrame, after: DataFrame, path: str = "rel_path", size: str = "size") -> DataFrame:
    """The rows of tree_diff, found in changed folders only: files of all other folders are not compared."""
    digests = [saved_table(folder_digests(tree, path, size), "digests") for tree in (before, after)]
    touched = changed_folders(*digests).where("own_differs").select(F.col("folder").alias("_folder"))
    inside = []
    for tree in (before, after):
        inside.append(tree.withColumn("_folder", parent_dir(path)).join(touched, "_folder", "left_semi").drop("_folder"))
    return tree_diff(*inside, path, size)
