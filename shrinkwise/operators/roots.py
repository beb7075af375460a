"""Roots of jobs that lie inside each other, among any number of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.functions.paths import normalize_path
from shrinkwise.operators.skew import HEAVY_ROWS, spread_join


def outer_dirs(path: Column) -> Column:
    """All folders above a normalised path, outermost first; "/" is above every absolute one."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(F.size(parts) > 1, F.transform(heads, lambda h: F.when(h == "", "/").otherwise(h))).otherwise(F.array().cast("array<string>"))


def containing_roots(roots: DataFrame, root: str = "root", heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """(outer, inner, levels): every pair of different roots of which one contains the other.

    Every root asks for all folders above it, a row for each level, and meets the roots among those in a join by path; so the
    work is the number of roots times their depth, not pairs of roots, and a root that contains most others is split
    over tasks. Paths are normalised first; equal ones are one root. Null and blank paths contain nothing and are in nothing.
    """
    known = roots.where(F.trim(root) != "").select(normalize_path(root).alias("inner")).distinct()
    above = known.select("inner", F.posexplode(outer_dirs(F.col("inner"))).alias("at", "outer")).where("outer != inner")
    pairs = spread_join(above, known.select(F.col("inner").alias("outer")), ["outer"], ["inner"], "inner", heavy_rows)
    depth = F.when(F.col("inner") == "/", 0).otherwise(F.size(F.split("inner", "/")))
    return pairs.select("outer", "inner", (depth - 1 - F.col("at")).alias("levels"))
