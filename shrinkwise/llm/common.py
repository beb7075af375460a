"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shrinkwise.session import new_shared_path, shuffles_removed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: For bytes.translate: A-Z to a-z, every other byte as it is.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def fields(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """Schema of some columns of `df` followed by those written out in `more`; all may be null."""
    kept = [T.StructField(c, df.schema[c].dataType, True) for c in columns]
    return T.StructType(kept + T.StructType.fromDDL(more).fields)


def map_batches(
    df: DataFrame, function: Callable[..., dict[str, object] | None], schema: T.StructType, setup: Callable[[], object] | None = None
) -> DataFrame:
    """Applies a function from a record batch to columns by name; a batch without result gives None.

    Batches are cut to about `SLICE_BYTES`, so that a worker holds few rows as Python objects at a time. `setup`
    makes what a task needs only once; the function gets it as its second argument.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = (setup(),) if setup else ()
        for batch in batches:
            rows = max(1, batch.num_rows * SLICE_BYTES // max(SLICE_BYTES, batch.nbytes))
            for first in range(0, batch.num_rows, rows):
                if (columns := function(batch.slice(first, rows), *more)) is not None:
                    yield batch_of(columns, arrow)

    return df.mapInArrow(run, schema)


def batch_of(columns: dict[str, object], arrow: pa.Schema) -> pa.RecordBatch:
    """Lists, numpy arrays or Arrow arrays by column name as a record batch of the given schema."""
    return pa.record_batch([_array(columns[f.name], f.type) for f in arrow], schema=arrow)


def _array(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def saved_texts(df: DataFrame, label: str) -> DataFrame:
    """Like saved_table, for tables with whole texts: packed more tightly."""
    path = new_shared_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between integers as (node, smallest node of its group), for all nodes but the smallest of each.

    The result connects the same nodes as the links do, with at most one row per node.
    """
    nodes, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    x, y = places[: len(left)], places[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]
