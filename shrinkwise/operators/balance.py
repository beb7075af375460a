"""Work by bytes: rows that stand for files are dealt to tasks by how much has to be read for them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.operators.skew import running_sums

#: Bytes that a task reads, about, and what opening a file counts besides its bytes.
SLICE_BYTES = 256 * 1024 * 1024
OPEN_BYTES = 256 * 1024
#: Payload bytes that a worker makes at a time, or one payload.
PIECE_BYTES = 8 * 1024 * 1024


def by_bytes(files: DataFrame, size: str = "size", order: Sequence[str] = ("path",), target: int = SLICE_BYTES) -> DataFrame:
    """The same rows in partitions of about `target` bytes each, neighbours in `order` together.

    A metadata table of a few megabytes may stand for terabytes, so its own partitions say nothing about the work. Sizes
    are summed up in order (in slices, so no task sees them all), and a row's partition is its running sum over the
    target. A larger file is a partition of its own. The partitions are final: adaptive execution does not merge them. Null and
    negative sizes count as zero.
    """
    cost = F.least(F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)) + OPEN_BYTES, F.lit(target)).cast("bigint")
    summed = running_sums(files.withColumn("_cost", cost), [], order, {"_before": "_cost"})
    last = summed.agg(F.max("_before")).first()[0]
    if last is None:
        return files
    slices = summed.repartitionById(last // target + 1, F.floor(F.col("_before") / F.lit(target)).cast("int"))
    return slices.select(*files.columns)


def payload_slices(batches: Iterable[pa.RecordBatch], column: str | int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices, without copies, that end where their payloads reach `limit` bytes.

    What a worker makes of a slice is handed on before the next, so its memory follows a slice, not a batch. No batch is held while
    the next one is fetched.
    """
    waiting = iter(batches)
    while (batch := next(waiting, None)) is not None:
        start, held = 0, 0
        for i, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), 1):
            held += length
            if held >= limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
        if start < batch.num_rows:
            yield batch.slice(start)
        batch = None
