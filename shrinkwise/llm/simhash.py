"""SimHash near-duplicates: tiled exact comparison of fingerprints."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import ASCII_LOWER, fields, local_forest, map_batches
from shrinkwise.llm.components import connected
from shrinkwise.session import saved_table

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Fingerprints in a tile, about: two tiles of 1024 make an 8 MB matrix of differences.
TILE = 1024
#: The 64 bits are counted in so many segments; counts of a segment have `SEGMENT_BASE` values at most.
SEGMENTS = 4
SEGMENT_BASE = 32
#: Shingles hashed at a time, so that one giant text needs little memory.
HASHED_AT_ONCE = 1 << 16


def simhash_near_duplicates(
    files: DataFrame, rel_path: str = "rel_path", text: str = "text", radius: int = RADIUS, tile: int = TILE
) -> DataFrame:
    """Near-duplicate files by SimHash: (rel_path, fingerprint, component_id), a row per input row.

    Words are what ASCII white space separates, after lower-casing A-Z; a shingle is three words joined by
    a space, repeats count, a shorter text is one shingle, and a text without words (empty or null) has
    fingerprint zero. A bit of the fingerprint is set if it is set in more than half the XXH64 values (seed 42).
    Files whose fingerprints differ in at most `radius` bits are linked; `component_id` is the smallest
    `rel_path` reachable over links, the file's own included.

    Distinct fingerprints are dealt into cells by the population counts of four 16-bit segments. The counts
    of two fingerprints cannot differ, summed over the segments, by more than the fingerprints do, so only
    cells within the radius are compared: tiles of about `tile` fingerprints, as numpy matrices of
    exclusive-or and bit counts. A crowded cell has several tiles, so no task gets a whole cell. A tile pair
    returns a spanning forest of its links, and components are found by Spark in the shared folder.

    Rows that share a rel_path share a component if their texts are alike and are otherwise separate rows;
    a null rel_path takes part and is never the smallest unless all of its component are null. Other
    columns are ignored, whatever their names. No rows give no rows.
    """
    prints = fingerprints(files, rel_path, text)
    prints = saved_table(prints, "prints")
    links = near_links(prints.select("_print").distinct(), radius, tile)
    roots = connected(links)
    labelled = prints.groupBy("_print").agg(F.min(rel_path).alias("_least"))
    labelled = labelled.join(roots.withColumnRenamed("node", "_print"), "_print", "left")
    labelled = saved_table(labelled.withColumn("root", F.coalesce("root", "_print")), "classes")
    least = labelled.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = saved_table(labelled.select("_print", "root").join(least, "root").drop("root"), "classes")
    digits = F.lower(F.lpad(F.hex("_print"), 16, "0"))
    return prints.join(classes, "_print").select(rel_path, digits.alias("fingerprint"), "component_id")


def fingerprints(files: DataFrame, rel_path: str, text: str) -> DataFrame:
    """(rel_path, _print), the fingerprint as a signed 64-bit integer."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        prints = b"".join(simhash(x) for x in batch.column(1).to_pylist())
        return {rel_path: batch.column(0), "_print": np.frombuffer(prints, ">i8").astype("i8")}

    return map_batches(files.select(rel_path, text), run, fields(files, [rel_path], "_print bigint"))


def simhash(text: str | None) -> bytes:
    """Fingerprint of a text, 8 bytes, most significant first."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return bytes(8)
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, HASHED_AT_ONCE):
        some = words[at : at + min(HASHED_AT_ONCE, n - at) + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(some, some[1:], some[2:])) if len(words) >= SHINGLE_WORDS else [b" ".join(some)]
        digests = b"".join([xxhash.xxh64_digest(s, SEED) for s in shingles])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        set_bits += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(set_bits * 2 > n).tobytes()


def near_links(prints: DataFrame, radius: int, tile: int) -> DataFrame:
    """(a, b): links that connect what all pairs of `_print` within the radius connect."""
    cells = prints.withColumn("cell", _cell(F.col("_print")))
    counts = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("_tiles"))
    share = F.pmod(F.xxhash64("_print"), F.col("_tiles")).cast("int")
    tiles = cells.join(counts, "cell").groupBy("cell", share.alias("share")).agg(F.collect_list("_print").alias("prints"))
    tiles = saved_table(tiles, "tiles")
    keys = tiles.select("cell", "share")
    steps = F.explode(F.array([F.lit(s) for s in _steps(radius)]))
    left = keys.select(F.col("cell").alias("cell_a"), F.col("share").alias("share_a"), steps.alias("step"))
    left = left.withColumn("cell_b", F.col("cell_a") + F.col("step")).drop("step")
    pairs = left.join(keys.toDF("cell_b", "share_b"), "cell_b")
    pairs = pairs.where("cell_a < cell_b or share_a <= share_b")
    pairs = pairs.join(tiles.toDF("cell_a", "share_a", "prints_a"), ["cell_a", "share_a"])
    pairs = pairs.join(tiles.toDF("cell_b", "share_b", "prints_b"), ["cell_b", "share_b"])
    pairs = pairs.select("prints_a", "prints_b")

    def run(batch: pa.RecordBatch) -> dict[str, object] | None:
        found = [compare(a, b, radius) for a, b in zip(_lists(batch.column(0)), _lists(batch.column(1)), strict=True)]
        nodes = np.concatenate([x for x, _ in found])
        return {"a": nodes, "b": np.concatenate([y for _, y in found])} if len(nodes) else None

    return map_batches(pairs, run, fields(pairs, [], "a bigint, b bigint"))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[i:j] for i, j in zip(ends, ends[1:])]


def compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles of fingerprints."""
    x, y = np.nonzero(np.bitwise_count(a.view("u8")[:, None] ^ b.view("u8")[None, :]) <= radius)
    return local_forest(a[x], b[y])


def _cell(fingerprint: Column) -> Column:
    """Population counts of the segments as the digits of one number."""
    width = 64 // SEGMENTS
    counts = [F.bit_count(F.shiftrightunsigned(fingerprint, width * i).bitwiseAND((1 << width) - 1)) for i in range(SEGMENTS)]
    return sum((c * SEGMENT_BASE**i for i, c in enumerate(counts)), F.lit(0)).cast("int")


def _steps(radius: int) -> list[int]:
    """From a cell to itself and to the higher ones whose counts differ by the radius at most."""
    moves = product(range(-radius, radius + 1), repeat=SEGMENTS)
    steps = (sum(m * SEGMENT_BASE**i for i, m in enumerate(move)) for move in moves if sum(map(abs, move)) <= radius)
    return sorted(s for s in steps if s >= 0)
