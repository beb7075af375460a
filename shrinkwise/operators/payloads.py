"""Per-file transforms of payload bytes in Arrow-fed Python workers."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Mapping
from datetime import datetime
from inspect import signature
from itertools import groupby
from time import monotonic

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shrinkwise.operators.balance import payload_slices
from shrinkwise.operators.routing import keep_smaller

#: bytes -> bytes, or bytes and the row's planned settings -> bytes.
Handler = Callable[..., bytes]

#: Time after which a task reports what it has done.
REPORT_SECONDS = 1.0

RESULT_FIELDS = [
    T.StructField("out_content", T.BinaryType()),
    T.StructField("out_size", T.LongType()),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("finished_at", T.TimestampNTZType()),
]


def takes_settings(handler: Handler) -> bool:
    """Whether a handler has a second parameter; handlers without a readable signature (zlib's) get bytes only."""
    try:
        required = [p for p in signature(handler).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    except (TypeError, ValueError):
        return False
    return len(required) > 1


def _run(handler: Handler, *given: object) -> tuple[bytes | None, int | None, bool, str | None]:
    """One file failing must not fail the task."""
    try:
        result = handler(*given)
        return result, len(result), True, None
    except Exception as exc:  # noqa: BLE001 - reported in the row
        return None, None, False, f"{type(exc).__name__}: {exc}"


def _report(batch: pa.RecordBatch, i: int, row: tuple, task: str) -> dict[str, object]:
    known = {c: batch.column(c)[i].as_py() for c in (task, "orig_size", "read_error") if c in batch.schema.names}
    error = known.get("read_error")
    ok = False if error is not None else row[2]
    return {"task_id": known[task], "orig_size": known.get("orig_size"), "out_size": row[1], "ok": ok, "error": error or row[3], "finished_at": row[4]}


def transform_payloads(
    df: DataFrame,
    handlers: Mapping[str, Handler],
    key: str = "ext",
    content: str = "content",
    keep_unhandled: bool = True,
    keep_original: bool = False,
    settings: str | None = None,
    on_done: Callable[[list[dict[str, object]]], None] | None = None,
    task: str = "audit_input",
) -> DataFrame:
    """Apply `handlers[ext](bytes) -> bytes`; adds out_content, out_size, ok, error, finished_at.

    One pass over the rows, so every file is read and handled once; bytes that have no handler pass through the
    worker in their Arrow buffers, without a copy. Those rows have ok = null. The original bytes are replaced
    by out_content; with `keep_original` that holds the original where there is no result (ok is then false or
    null and out_size null). finished_at is the time when a row was done. A handler with two parameters gets
    the row's `settings`, a struct column, as a dict; that column is not returned. Other columns are carried along.

    `on_done` is called in the tasks while they work, about every REPORT_SECONDS and at the end of a batch, with the rows done since:
    task_id (the column `task`), orig_size, out_size, ok, error and finished_at. A task that is run again reports again.
    """
    carried = [f for f in df.schema.fields if f.name not in (content, settings)]
    schema = T.StructType(carried + RESULT_FIELDS)
    arrow_schema = to_arrow_schema(schema)
    names = [f.name for f in carried]
    table = dict(handlers)
    planned = {kind for kind, handler in table.items() if settings and takes_settings(handler)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in payload_slices(batches, content):
            kinds, blobs = batch.column(key).to_pylist(), batch.column(content)
            handled = [i for i, kind in enumerate(kinds) if kind in table and blobs[i].is_valid]
            done: dict[int, tuple] = {}
            waiting, reported = [], monotonic()
            for i in handled:
                more = (batch.column(settings)[i].as_py(),) if kinds[i] in planned else ()
                done[i] = (*_run(table[kinds[i]], blobs[i].as_py(), *more), datetime.now())
                waiting.append(i)
                if on_done is not None and monotonic() - reported >= REPORT_SECONDS:
                    on_done([_report(batch, k, done[k], task) for k in waiting])
                    waiting, reported = [], monotonic()
            none = (None, None, None, None, datetime.now())
            rows = [done.get(i, none) for i in range(batch.num_rows)]
            if on_done is not None and (left := [*waiting, *(i for i in range(batch.num_rows) if i not in done)]):
                on_done([_report(batch, k, rows[k], task) for k in left])
            if keep_original and len(done) < batch.num_rows:
                # Runs of rows that keep their bytes are slices of the input; nothing of them becomes a Python object.
                keeps = [i not in done or rows[i][0] is None for i in range(batch.num_rows)]
                pieces, at = [], 0
                for keep, run in groupby(keeps):
                    n = len(list(run))
                    kind = arrow_schema.field("out_content").type
                    pieces.append(blobs.slice(at, n).cast(kind) if keep else pa.array([r[0] for r in rows[at : at + n]], kind))
                    at += n
                contents = pa.concat_arrays(pieces)
            else:
                rows = [(blobs[i].as_py() if keep_original and r[0] is None else r[0], *r[1:]) for i, r in enumerate(rows)]
                contents = pa.array([r[0] for r in rows], type=arrow_schema.field("out_content").type)
            columns = [batch.column(n) for n in names] + [contents]
            columns += [pa.array([r[i] for r in rows], type=arrow_schema.field(f.name).type) for i, f in enumerate(RESULT_FIELDS) if i]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip(columns, arrow_schema, strict=True)], schema=arrow_schema
            )

    if not keep_unhandled:
        df = df.where(F.col(key).isin(*table) & F.col(content).isNotNull() if table else F.lit(False))
    return df.mapInArrow(work, schema)


def recompress_payloads(df: DataFrame, level: int = 9, content: str = "content", keep_original: bool = False) -> DataFrame:
    """Lossless deflate of every payload, kept only if smaller than the original.

    Adds orig_size, new_size, accepted, kept_size and out_content (null when the original stays). With
    `keep_original` the original stays in its column as well.
    """
    if keep_original:
        df = df.withColumn("_original", F.col(content))
    tagged = df.withColumns({"_kind": F.lit("any"), "orig_size": F.octet_length(content).cast("bigint")})
    packed = transform_payloads(
        tagged, {"any": lambda data: zlib.compress(data, level)}, key="_kind", content=content
    )
    judged = keep_smaller(packed.withColumnRenamed("out_size", "new_size"), "orig_size", "new_size")
    judged = judged.withColumn("out_content", F.when(F.col("accepted"), F.col("out_content"))).drop("_kind", "finished_at")
    return judged.withColumnRenamed("_original", content)
