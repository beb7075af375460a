"""Joins and running sums that keep their work spread when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shrinkwise.session import pinned

# A key with more rows than this is split. Adaptive execution broadcasts the list of such keys if it is small.
HEAVY_ROWS = 2_000_000


def key_counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def _shares(rows: Column, heavy_rows: int) -> Column:
    """How many tasks a key's rows are split over; one unless it is heavy."""
    return F.when(rows > heavy_rows, F.ceil(rows / heavy_rows)).otherwise(1).cast("int")


def heavy_keys(counts: DataFrame, keys: Sequence[str], heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Keys whose `_rows` exceed the limit, with their number of shares."""
    heavy = counts.where(F.col("_rows") > heavy_rows)
    return heavy.select(*keys, _shares(F.col("_rows"), heavy_rows).alias("_shares"))


def spread_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "left",
    heavy_rows: int = HEAVY_ROWS,
    counts: DataFrame | None = None,
    large_lookup: bool = False,
) -> DataFrame:
    """Join many rows to a lookup holding each key once; heavy keys are split over several tasks.

    Rows of a heavy key get a share number from `spread_by`, and only that key's lookup row is
    repeated per share. Ordinary keys are shuffled once, as in a plain join. Rows with a null key
    match nothing, exactly as in SQL.

    `counts` (keys, _rows) saves counting when an aggregation of the same rows exists already; a key
    it lacks is taken as ordinary. A lookup column `_rows` with those same counts saves looking
    them up again; it is dropped.

    `large_lookup` says that the lookup grows like the rows, so both sides are shuffled. Size estimates do not see what
    an explode adds, and the driver would gather such a lookup to broadcast it.
    """
    if counts is None:
        counts = key_counts(rows, keys)
    heavy = heavy_keys(counts, keys, heavy_rows)
    shares = F.coalesce(F.col("_shares"), F.lit(1))
    left = (
        rows.join(heavy, list(keys), "left")
        .withColumn("_share", F.pmod(F.xxhash64(*spread_by), shares).cast("int"))
        .drop("_shares")
    )
    if "_rows" in lookup.columns:
        known = lookup.withColumn("_shares", _shares(F.col("_rows"), heavy_rows)).drop("_rows")
    else:
        known = lookup.join(heavy, list(keys), "left")
    right = known.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
    if large_lookup:
        right = right.hint("merge")
    return left.join(right, [*keys, "_share"], how).drop("_share")


def running_sums(
    df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, str]
) -> DataFrame:
    """Add exclusive running sums (`{new column: summed column}`) per group in the given order.

    The rows are range-partitioned on group and order, so a huge group spans many slices. Slices
    are pinned by a reliable checkpoint, summed, and each slice starts from the sum of those before
    it. No window ever holds more than one slice of a group.
    """
    sliced = pinned(df.repartitionByRange(*group, *order).withColumn("_slice", F.spark_partition_id()))
    slice_keys = [*group, "_slice"]
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sliced.groupBy(*slice_keys)
        .agg(*[F.sum(column).alias(f"_sum_{name}") for name, column in sums.items()])
        .select(
            *slice_keys,
            *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_base_{name}") for name in sums],
        )
    )
    before = Window.partitionBy(*slice_keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # Groups may be null: keys are compared with nulls as equal.
    bases = bases.select(F.struct(*slice_keys).alias("_keys"), *[f"_base_{name}" for name in sums])
    out = sliced.withColumn("_keys", F.struct(*slice_keys)).join(bases, "_keys").drop("_keys")
    for name, column in sums.items():
        within = F.coalesce(F.sum(column).over(before), F.lit(0))
        out = out.withColumn(name, (F.col(f"_base_{name}") + within).cast("bigint"))
    return out.drop("_slice", *[f"_base_{name}" for name in sums])
