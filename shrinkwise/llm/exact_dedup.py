"""Exact duplicates by deterministic block naming, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import ascii_lower
from shrinkwise.session import saved_table

#: Bytes of a block. A text of n blocks needs log2(n) rounds of naming.
BLOCK = 4096


def exact_duplicates(files: DataFrame, rel_path: str = "rel_path", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Files with equal texts: (rel_path, keep_id, group_size, kept, text_sha256), a row per input row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest rel_path stays (`keep_id` in all rows of the group, `kept` in that row); of
    rows that also share the rel_path, one. Nulls in rel_path are smaller than anything.

    A text alone with its SHA-256 has no equal. All others are cut into blocks of `block` bytes. Distinct
    blocks are sorted and so named by integers; then neighbouring names are paired, and the distinct pairs
    sorted and named, until every text has one name. Different texts never get the same name in a round:
    names stand one to one for blocks or pairs, and a text without a right neighbour pairs with nothing.
    So equal names mean equal texts, whatever the digests say. Equal blocks and pairs are aggregated
    before they are sorted, and names come from saved tables, so joins on a popular block can be split.

    Other columns are ignored, whatever their names. No rows give no rows.
    """
    rows = files.select(F.col(rel_path).alias("_key"), ascii_lower(F.col(text)).alias("_text"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    digests = rows.select("_key", "_sha")
    shared = saved_table(digests.groupBy("_sha").count().where("count > 1").select("_sha"), "shared")
    # What the joins are with grows with the input: no broadcast, at any size.
    shared = shared.hint("merge")
    alone = digests.join(shared, "_sha", "left_anti").select(
        "_key", F.col("_key").alias("_keep"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "_sha"
    )
    several = rows.join(shared, "_sha").withColumn("_row", F.monotonically_increasing_id())
    several = saved_table(several, "several")
    named = block_names(several, block)
    groups = named.join(several.select("_row", "_key"), "_row").groupBy("name")
    groups = groups.agg(F.max(F.struct("_key", "_row")).alias("_last"), F.count(F.lit(1)).alias("group_size"))
    groups = saved_table(groups, "groups")
    settled = several.select("_row", "_key", "_sha").join(named, "_row").join(groups, "name")
    settled = settled.select(
        "_key", F.col("_last._key").alias("_keep"), "group_size", (F.col("_last._row") == F.col("_row")).alias("kept"), "_sha"
    )
    return alone.union(settled).toDF(rel_path, "keep_id", "group_size", "kept", "text_sha256")


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_row, name) for (_row, _text): equal names for equal texts, different names for different ones."""
    size = F.octet_length("_text")
    count = F.greatest(F.ceil(size / block), F.lit(1)).cast("int")
    longest = texts.agg(F.max(count)).first()[0] or 1
    data = F.col("_text").cast("binary")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * block + 1, F.lit(block)))
    blocks = texts.select("_row", F.posexplode(cut).alias("pos", "block"))
    level = _named(blocks, ["block"])
    while longest > 1:
        side = F.col("pos") % 2
        pairs = level.groupBy("_row", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.when(side == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(side == 1, F.col("name"))), F.lit(-1)).alias("right")
        )
        level = _named(pairs, ["left", "right"])
        longest = (longest + 1) // 2
    return level.select("_row", "name")


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Replaces the columns `by` with the place of their value among the sorted distinct ones.

    Distinct values are dealt by their hash, sorted in each partition and numbered through: no ranges of whole blocks
    are sampled to the driver, and values that begin alike do not meet in one task.
    """
    names = rows.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())
    named = rows.join(saved_table(names, "names"), by)
    return saved_table(named.select("_row", "pos", "name"), "level")
