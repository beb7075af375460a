"""Embedding near-duplicates: tiled comparison of vectors in the order of their principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import batch_of, fields, local_forest, map_batches
from shrinkwise.llm.components import connected
from shrinkwise.session import saved_table

COSINE = 0.98
#: Vectors in a tile at most, and bytes of their components. A tile is what travels.
TILE, TILE_BYTES = 4096, 16 << 20
#: Vectors of a tile compared at once.
BLOCK = 512
#: Parts in which the tiles of a cell meet.
SPREAD = 16
#: Leading dimensions added at a time before the bound is looked at.
STEP = 8
#: A bound must fail by this much: rounding in sums of products of unit vectors stays far below it.
SLACK = 1e-9


def embedding_near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE,
    tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """Near-duplicate vectors within a label: (vec_id, n_links, component_id, kept), a row per input row.

    Two vectors are linked when their labels are equal and not null and their cosine, in double precision,
    is at least `cosine`. A vector that is null, zero, or holds null or non-finite components has no link.
    `component_id` is the smallest vec_id reachable, `kept` says that it is the row's own. The library's
    records hold no vectors, so this operator is general: give an image's id as `vec_id` and its type as
    `label` to compare pictures of a type.

    Equal vectors of a label are one class with a count. Classes are rotated to the principal axes of all
    unit vectors, and range-partitioned by label, band of the first coordinate and second coordinate into tiles
    of at most `tile`. Unit vectors with that cosine differ by at most sqrt(2 - 2 cosine), so only tiles whose
    first and second coordinates come so near meet. A tile travels once for each tile that it meets and is
    compared with itself where it is made; inside, blocks of at most `block` are compared if their boxes come
    near in all coordinates together: leading coordinates are accumulated `STEP` at a time, the rest of each
    product is bounded by the norms of what is left, and a pair, or the block pair, is given up as soon as it
    cannot reach the cosine. What survives is decided by the products of the given vectors.

    Rows with a null vec_id count as links but are never a component's smallest; rows that share a vec_id
    are rows of their own. Vectors of different lengths are not linked. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("_id"), F.col(label).alias("_label"), F.col(embedding).cast("array<double>").alias("_vec"))
    good = F.exists("_vec", lambda x: x != 0) & F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(F.col("_label").isNotNull() & good, F.lit(False))
    rows = rows.withColumn("_class", F.when(good, F.struct(F.col("_label").alias("label"), F.col("_vec").alias("vec"))))
    known = rows.where(F.col("_class").isNotNull())
    classes = known.groupBy("_class").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_count"))
    classes = classes.withColumn("_node", F.monotonically_increasing_id())
    classes = saved_table(classes.select("_node", "_class.label", "_class.vec", "_least", "_count"), "classes")
    found = saved_table(_links(classes, cosine, tile, block), "found")
    roots = connected(found.where("b is not null").select("a", "b"))
    degrees = found.where("b is null").groupBy(F.col("a").alias("_node")).agg(F.sum("n").alias("_others"))
    wide = classes.join(degrees, "_node", "left").join(roots.withColumnRenamed("node", "_node"), "_node", "left")
    wide = saved_table(wide.withColumn("root", F.coalesce("root", "_node")), "wide")
    least = wide.groupBy("root").agg(F.min("_least").alias("_component"))
    links = (F.coalesce("_others", F.lit(0)) + F.col("_count") - 1).cast("bigint").alias("_links")
    settled = wide.join(least, "root").select(F.struct("label", "vec").alias("_class"), links, "_component")
    settled = saved_table(settled, "settled")
    out = rows.select("_id", "_class").join(settled, "_class", "left")
    component = F.coalesce("_component", "_id")
    return out.select(
        F.col("_id").alias(vec_id), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _links(classes: DataFrame, cosine: float, tile: int, block: int) -> DataFrame:
    """Forest links (a, b, null), and for each class and tile pair (a, null, rows linked with it)."""
    axes = {d: principal_axes(classes, d) for d in sorted(r[0] for r in classes.select(F.size("vec")).distinct().collect())}
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    tiles = saved_table(_tiles(classes, axes, tile, reach), "tiles")
    data = ["nodes", "counts", "vecs"]
    own = tiles.select("size", *[F.col(c).alias(f"{c}_a") for c in data], *[F.lit(None).cast("binary").alias(f"{c}_b") for c in data])
    a = tiles.select("tile", "size", *[F.col(c).alias(f"{c}_a") for c in data])
    b = tiles.select(F.col("tile").alias("tile_b"), *[F.col(c).alias(f"{c}_b") for c in data])
    pairs = _tile_pairs(tiles, reach).join(a, "tile").join(b, "tile_b").select(own.columns)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        out = [_compare(row, axes[row["size"]], cosine, block) for row in batch.to_pylist()]
        return {k: pa.concat_arrays([pa.array(x[i], pa.int64()) for x in out]) for i, k in enumerate(("a", "b", "n"))}

    schema = fields(pairs, [], "a bigint, b bigint, n bigint")
    return map_batches(own, run, schema).union(map_batches(pairs, run, schema))


def _tile_pairs(tiles: DataFrame, reach: float) -> DataFrame:
    """(tile, tile_b) of different tiles that come near on the first two axes.

    Tiles meet in the cells of a grid over the first coordinate, in `SPREAD` parts of each; a pair is taken in the
    first cell that both share. Only names and bounds of tiles are joined here.
    """
    bounds = ("tile", "low", "high", "low2", "high2")
    cells = lambda low, high: F.sequence(F.floor(low / reach), F.floor(high / reach))
    keys = tiles.select("label", "size", *bounds)
    left = keys.withColumn("cell", F.explode(cells(F.col("low"), F.col("high")))).withColumn("share", F.pmod(F.xxhash64("tile"), F.lit(SPREAD)))
    right = keys.withColumn("cell", F.explode(cells(F.col("low") - reach, F.col("high") + reach)))
    right = right.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<bigint>")))
    right = right.select("label", "size", "cell", "share", *[F.col(c).alias(f"{c}_b") for c in bounds])
    pairs = left.join(right, ["label", "size", "cell", "share"]).where("tile < tile_b")
    for low, high in (("low", "high"), ("low2", "high2")):
        pairs = pairs.where((F.col(low) <= F.col(f"{high}_b") + reach) & (F.col(f"{low}_b") <= F.col(high) + reach))
    first = F.greatest(F.floor(F.col("low") / reach), F.floor((F.col("low_b") - reach) / reach))
    return pairs.where(F.col("cell") == first).select("tile", "tile_b")


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """Principal axes, as columns, strongest first, of all unit vectors with `size` components.

    Workers add up outer products; Spark adds the sums entry by entry, so size x size numbers reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = unit(_matrix(batch.column(0), size))
            total += x.T @ x
        yield pa.record_batch({"at": pa.array(np.arange(size * size)), "v": pa.array(total.ravel())})

    sums = classes.where(F.size("vec") == size).select("vec").mapInArrow(run, "at bigint, v double").groupBy("at").sum("v")
    moment = np.zeros(size * size)
    for at, v in sums.collect():
        moment[at] = v
    values, axes = np.linalg.eigh(moment.reshape(size, size))
    return axes[:, np.argsort(-values)]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest entry first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ListArray, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _tiles(classes: DataFrame, axes: dict[int, np.ndarray], tile: int, reach: float) -> DataFrame:
    """A row per tile: its bounds on the first two axes and its classes' unit vectors as bytes."""
    data = fields(classes, ["label"], "size int, tile bigint, low double, high double, low2 double, high2 double, nodes binary, counts binary, vecs binary")
    kept = ["_node", "label", "vec", "_count"]

    def turn(batch: pa.RecordBatch) -> dict[str, object]:
        vecs, first, second = batch.column("vec").to_pylist(), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
        sizes = np.array([len(v) for v in vecs])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            turned = unit(np.array([vecs[i] for i in at])) @ axes[size][:, :2]
            first[at], second[at] = turned[:, 0], turned[:, -1]
        band = np.floor(first / reach).astype(np.int64)
        return {**{c: batch.column(c) for c in kept}, "size": sizes, "first": first, "second": second, "band": band}

    turned = map_batches(classes.select(kept), turn, fields(classes, kept, "size int, first double, second double, band bigint"))
    order = ["label", "size", "band", "second", "_node"]
    parts = max(1, classes.count() // (4 * tile) + 1)
    sorted_rows = turned.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    sorted_rows = sorted_rows.withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        held, done, arrow = [], 0, to_arrow_schema(data)
        for batch in batches:
            for row in batch.to_pylist():
                full = min(tile, max(1, TILE_BYTES // (8 * row["size"])))
                if held and (len(held) >= full or (held[0]["label"], held[0]["size"]) != (row["label"], row["size"])):
                    yield batch_of(_tile(held, done), arrow)
                    held, done = [], done + 1
                held.append(row)
        if held:
            yield batch_of(_tile(held, done), arrow)

    return sorted_rows.mapInArrow(cut, data)


def _tile(rows: list[dict], number: int) -> dict[str, list]:
    column = lambda name: [r[name] for r in rows]
    first, second = column("first"), column("second")
    return {
        "label": [rows[0]["label"]], "size": [rows[0]["size"]], "tile": [(rows[0]["part"] << 32) + number],
        "low": [min(first)], "high": [max(first)], "low2": [min(second)], "high2": [max(second)],
        "nodes": [np.array(column("_node")).tobytes()], "counts": [np.array(column("_count")).tobytes()],
        "vecs": [unit(np.array(column("vec"), float)).tobytes()],
    }


def _compare(row: dict, axes: np.ndarray, cosine: float, block: int) -> tuple[list, list, list]:
    """Forest of the links of a tile pair as (a, b, None), then linked rows of each class as (a, None, n).

    Without a second tile the first one is compared with itself.
    """
    same = row["nodes_b"] is None
    read = lambda name, side, kind: np.frombuffer(row[f"{name}_{side}"], kind)
    sides = [(read("nodes", s, np.int64), read("counts", s, np.int64), read("vecs", s, float).reshape(-1, len(axes))) for s in ("a" if same else "ab")]
    (na, ca, va), (nb, cb, vb) = sides[0], sides[-1]
    turned = [v @ axes for _, _, v in sides]
    ta, tb = turned[0], turned[-1]
    n = [np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)]
    forest: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j in near_blocks(ta, tb, cosine, block):
        if same and j < i:
            continue
        x, y = near_pairs(ta[i : i + block], tb[j : j + block], cosine)
        x, y = x + i, y + j
        if same and i == j:
            x, y = x[x < y], y[x < y]
        near = np.einsum("ij,ij->i", va[x], vb[y]) >= cosine
        x, y = x[near], y[near]
        forest.append(local_forest(na[x], nb[y]))
        n[0] += np.bincount(x, cb[y], len(na)).astype(np.int64)
        n[1] += np.bincount(y, ca[x], len(nb)).astype(np.int64)
    linked = [(ids[k > 0], k[k > 0]) for ids, k in zip((na, nb), n, strict=True)]
    a = [v for nodes, _ in forest for v in nodes.tolist()]
    b = [v for _, roots in forest for v in roots.tolist()]
    count = [int(v) for _, k in linked for v in k]
    return [*a, *(v for ids, _ in linked for v in ids.tolist())], [*b, *[None] * len(count)], [*[None] * len(a), *count]


def near_blocks(a: np.ndarray, b: np.ndarray, cosine: float, block: int) -> Iterator[tuple[int, int]]:
    """Starts of blocks of rows whose boxes come near enough for a pair with the cosine."""
    box = lambda m: [(i, m[i : i + block].min(axis=0), m[i : i + block].max(axis=0)) for i in range(0, len(m), block)]
    others = box(b)
    for i, low, high in box(a):
        for j, low_b, high_b in others:
            gap = np.maximum(0, np.maximum(low - high_b, low_b - high))
            if gap @ gap <= 2 - 2 * cosine + SLACK:
                yield i, j


def near_pairs(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose product may reach the cosine, leading dimensions first; all that do are among them."""
    size = a.shape[1]
    rest = lambda m: np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norms of what is left from each dimension on
    ra, rb = (np.hstack([rest(m), np.zeros((len(m), 1))]) for m in (a, b))
    least = cosine - SLACK
    at = min(STEP, size)
    product = a[:, :at] @ b[:, :at].T
    x, y = np.nonzero(product + ra[:, at, None] * rb[None, :, at] >= least)
    product = product[x, y]
    while at < size and len(x):
        to = min(at + STEP, size)
        product = product + np.einsum("ij,ij->i", a[x, at:to], b[y, at:to])
        near = product + ra[x, to] * rb[y, to] >= least
        x, y, product, at = x[near], y[near], product[near], to
    return x, y
