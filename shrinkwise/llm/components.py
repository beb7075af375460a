"""Connected components of links between integers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.session import saved_table


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node with a link, roots included; root is the smallest node reachable.

    `links` has two bigint columns, `a` and `b`; repeated links, loops and either direction are fine,
    rows with a null are not links. Rounds of the large-star and small-star steps, each of which keeps
    connectivity and moves links towards smaller nodes, until a round changes nothing; the number of
    rounds grows with the logarithm of the longest path. Every round is a Parquet table in the shared
    folder, so a lost executor costs at most one round, and the driver sees only counts and checksums.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = saved_table(edges, "links"), None
    while (now := _state(edges)) != before and now[0]:
        edges, before = saved_table(_small_star(saved_table(_large_star(edges), "links")), "links"), now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select("v", "v").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and checksum: equal states mean that a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to its smallest neighbour, itself included."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved_table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    moved = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") > F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every node, and the node, are linked to the smallest of them."""
    least = saved_table(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
