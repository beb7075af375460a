"""Removal of repeated passages: windows of words counted exactly in buckets of super-k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shrinkwise.llm.common import batch_of, fields, map_batches, saved_texts
from shrinkwise.operators.skew import spread_join
from shrinkwise.session import saved_table

#: Words of a window.
WINDOW = 35
#: Words of the sequences among which a window's minimiser is found.
GRAM = 4
#: Windows in the different super-k-mers of one minimiser above which they are counted one by one, by their digests.
BUCKET = 1 << 17
#: Windows of a super-k-mer at most; one that goes on, where few words repeat, is cut into stretches.
STRETCH = 512
#: Bytes of a word above which its SHA-256 stands for it in a bucket.
LONG_WORD = 64
#: A minimiser's hash and its place share 64 bits; longer texts are gone through in overlapping parts.
PLACE_BITS = 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def remove_repeated_passages(
    files: DataFrame,
    rel_path: str = "rel_path",
    text: str = "text",
    window: int = WINDOW,
    bucket: int = BUCKET,
    whole: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Texts without the passages that occur elsewhere: (rel_path, n_words, n_removed, kept), a row per input row.

    Words are what ASCII white space separates. A window is `window` consecutive words; every word covered
    by a window whose words also start anywhere else, in the same text or another, is removed. Windows are
    judged on the texts as given, so no occurrence is spared. `kept` is the remaining words joined by a space;
    with `whole`, a text that loses nothing is returned as it was. Columns named in `carry` follow the others.

    Consecutive windows that share a minimiser (the smallest hash of `GRAM` consecutive words inside) make
    a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser occurs again,
    counted over all texts, go on. Equal super-k-mers (SHA-256) are counted: with a second copy all their
    windows are repeated. Of minimisers with different super-k-mers, or one that overlaps itself, one packed
    string per kind travels to the minimiser's bucket, where its windows are sorted and counted with the
    copies' weight. Windows of a minimiser whose kinds have more than `bucket` windows are counted by their SHA-256 instead, in
    an aggregation, so no task holds more than a bucket; a kind has at most STRETCH windows.

    Null and empty texts have no words. Rows are told apart by rel_path and text; equal rows repeat each
    other, so all of their windows go. Other columns are ignored, whatever their names. No rows give none.
    """
    ident = F.struct(F.col(rel_path).alias("key"), F.xxhash64(text).alias("hash")).alias("_id")
    docs = files.select(ident, F.col(text).alias("_text"), F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("_more"))
    runs = _runs(docs.select("_id", "_text"), window)
    again = runs.groupBy("value").agg(F.sum("weight").alias("n")).where("n >= 2").select("value")
    suspects = runs.join(saved_table(again, "again"), "value").groupBy("_id")
    suspects = suspects.agg(F.collect_set(F.struct("first", "last", "value", "weight")).alias("runs"))
    # One shuffle of the texts: those without a run that occurs again are done, the others are a smaller table.
    texts = saved_texts(docs.join(suspects.hint("merge"), "_id", "left"), "texts")
    suspects = texts.where("runs is not null")
    kinds, copies = _kinds(suspects, window)
    spans = copies.union(_bucket_spans(suspects, kinds, window, bucket))
    spans = saved_table(spans.groupBy("_id").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "spans")
    spans = texts.where("runs is null").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).unionByName(
        suspects.join(spans.hint("merge"), "_id", "left")
    )
    return _without(spans, window, whole, carry).withColumnRenamed("key", rel_path)


def _runs(docs: DataFrame, window: int) -> DataFrame:
    """Super-k-mers (_id, value, first, last, weight): windows from first to last have the minimiser value.

    weight is 2 if the minimiser stands there more than once, so that one super-k-mer may repeat a window.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object] | None:
        found = [super_kmers((t or "").encode().split(), window) for t in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [f.shape[1] for f in found])
        value, first, last, weight = np.concatenate(found, axis=1)
        return {"_id": batch.column(0).take(pa.array(rows)), "value": value, "first": first, "last": last, "weight": weight}

    return map_batches(docs, run, fields(docs, ["_id"], "value bigint, first bigint, last bigint, weight bigint"))


def super_kmers(words: list[bytes], window: int) -> np.ndarray:
    """Rows value, first, last and weight, with a column per super-k-mer."""
    limit = (1 << PLACE_BITS) - 1
    parts = [_part_kmers(words[at : at + limit], window, at) for at in range(0, max(1, len(words) - window + 1), limit - window + 1)]
    return np.concatenate(parts, axis=1)


def _part_kmers(words: list[bytes], window: int, at: int) -> np.ndarray:
    gram = min(GRAM, window)
    if len(words) < window:
        return np.zeros((4, 0), np.int64)
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in words]), ">u8").astype(np.uint64)
    mixed = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        mixed = mixed * _ODD + hashes[i : i + len(mixed)]
    mixed ^= mixed >> np.uint64(29)
    mixed = (mixed * _ODD) >> np.uint64(PLACE_BITS + 1) << np.uint64(PLACE_BITS)
    place, top = np.arange(len(mixed), dtype=np.uint64), np.uint64((1 << PLACE_BITS) - 1)
    left = sliding_min(mixed | place, window - gram + 1)
    right = sliding_min(mixed | (top - place), window - gram + 1)
    value = left >> np.uint64(PLACE_BITS)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(first, len(value)))
    weight = 1 + ((left[first] & top) != top - (right[first + size - 1] & top))
    # Stretches keep the weight of the whole: it has its minimiser more than once.
    stretches = -(-size // STRETCH)
    of = np.repeat(np.arange(len(first)), stretches)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    last = np.minimum(first[of] + (nth + 1) * STRETCH, first[of] + size[of]) - 1
    first, weight = first[of] + nth * STRETCH, weight[of]
    return np.stack([value[first].astype(np.int64), first + at, last + at, weight])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every `width` consecutive ones, by doubling."""
    span, total = 1, len(x) - width + 1
    while 2 * span <= width:
        x, span = np.minimum(x[:-span], x[span:]), 2 * span
    return np.minimum(x[:total], x[width - span : width - span + total])


def _kinds(suspects: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct super-k-mers (value, digest, copies, weight, _id, first, last), one occurrence of each; and
    spans (_id, first, last) of all occurrences that have a second copy."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        rows, out, digests = [], [], []
        for i, (text, runs) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            words = text.encode().split()
            for r in runs:
                rows.append(i)
                out.append((r["value"], r["first"], r["last"], r["weight"]))
                digests.append(hashlib.sha256(b" ".join(words[r["first"] : r["last"] + window])).digest())
        columns = dict(zip(("value", "first", "last", "weight"), np.array(out, np.int64).reshape(-1, 4).T, strict=True))
        return {"_id": batch.column(0).take(pa.array(rows, pa.int64())), "digest": digests, **columns}

    found = map_batches(
        suspects.select("_id", "_text", "runs"), run, fields(suspects, ["_id"], "digest binary, value bigint, first bigint, last bigint, weight bigint")
    )
    found = saved_table(found, "kmers")
    kinds = found.groupBy("value", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("weight").alias("weight"), F.min(F.struct("_id", "first", "last")).alias("at")
    )
    kinds = saved_table(kinds.select("value", "digest", "copies", "weight", "at.*"), "kinds")
    several = kinds.where("copies >= 2").select("value", "digest")
    return kinds, found.join(several, ["value", "digest"]).select("_id", "first", "last")


def _bucket_spans(suspects: DataFrame, kinds: DataFrame, window: int, bucket: int) -> DataFrame:
    """Spans (_id, first, last) of repeated windows in super-k-mers that have no second copy."""
    windows = F.sum(F.col("last") - F.col("first") + 1).alias("windows")
    values = kinds.groupBy("value").agg(F.count(F.lit(1)).alias("n"), windows, F.max("weight").alias("most"))
    values = values.where("n > 1 or most > 1")
    values = saved_table(values.select("value", (F.col("windows") > bucket).alias("large")), "values")
    # Equal rows have the same _id and the same text: one of them is enough to cut from.
    texts = suspects.dropDuplicates(["_id"]).select("_id", "_text")

    def cut(large: bool) -> DataFrame:
        """Super-k-mers of the minimisers that are large or not, as strings, or each window's digest."""

        def run(batch: pa.RecordBatch) -> dict[str, object]:
            rows, strings, out = [], [], []
            for i, (text, all_sent) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = [w if len(w) <= LONG_WORD else b"\t" + hashlib.sha256(w).hexdigest().encode() for w in text.encode().split()]
                for s in all_sent:
                    step = 1 if large else s["last"] - s["first"] + 1
                    for first in range(s["first"], s["last"] + 1, step):
                        string = b" ".join(words[first : first + step - 1 + window])
                        rows.append(i)
                        strings.append(hashlib.sha256(string).digest() if large else string)
                        out.append((s["value"], first, s["copies"]))
            columns = dict(zip(("value", "first", "copies"), np.array(out, np.int64).reshape(-1, 3).T, strict=True))
            return {"_id": batch.column(0).take(pa.array(rows, pa.int64())), "packed": strings, **columns}

        sent = kinds.join(values.where("large" if large else "not large").select("value"), "value").groupBy("_id")
        sent = saved_table(sent.agg(F.collect_list(F.struct("value", "first", "last", "copies")).alias("sent")), "sent")
        return map_batches(texts.join(sent, "_id"), run, fields(suspects, ["_id"], "packed binary, value bigint, first bigint, copies bigint"))

    packed = cut(False).repartition("value").sortWithinPartitions("value")
    schema = fields(suspects, ["_id"], "first bigint, last bigint")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, held, at = to_arrow_schema(schema), [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["value"] != at:
                    out += repeated_windows(held, window)
                    held, at = [], row["value"]
                held.append(row)
            if out:
                yield batch_of(dict(zip(("_id", "first", "last"), zip(*out), strict=True)), arrow)
        if out := repeated_windows(held, window):
            yield batch_of(dict(zip(("_id", "first", "last"), zip(*out), strict=True)), arrow)

    spans = packed.mapInArrow(count, schema)
    if values.where("large").isEmpty():
        return spans
    singles = saved_table(cut(True), "singles")
    again = singles.groupBy("value", "packed").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("_rows")).where("n >= 2").select("value", "packed", "_rows")
    again = saved_table(again, "windows")
    # Other copies of a kind are repeated anyway; a window found everywhere is spread over tasks.
    hits = spread_join(singles.where("copies = 1"), again, ["value", "packed"], ["_id", "first"], "inner", counts=again)
    return spans.union(hits.select("_id", "first", F.col("first").alias("last")))


def repeated_windows(rows: list[dict], window: int) -> list[tuple[dict, int, int]]:
    """Windows of a bucket's strings that have an equal one, found by sorting; of single strings only."""
    windows = []
    for i, row in enumerate(rows):
        words = row["packed"].split(b" ")
        windows += [(b" ".join(words[j : j + window]), i, j) for j in range(len(words) - window + 1)]
    windows.sort()
    hits: list[tuple[int, int]] = []
    at = 0
    while at < len(windows):
        to = at + 1
        while to < len(windows) and windows[to][0] == windows[at][0]:
            to += 1
        if to - at > 1 or rows[windows[at][1]]["copies"] > 1:
            hits += [(i, j) for _, i, j in windows[at:to] if rows[i]["copies"] == 1]
        at = to
    out: list[tuple[dict, int, int]] = []
    for i, j in sorted(hits):
        first = rows[i]["first"] + j
        if out and out[-1][0] is rows[i]["_id"] and out[-1][2] == first - 1:
            out[-1] = (rows[i]["_id"], out[-1][1], first)
        else:
            out.append((rows[i]["_id"], first, first))
    return out


def _without(docs: DataFrame, window: int, whole: bool, carry: Sequence[str]) -> DataFrame:
    """(key, n_words, n_removed, kept, carried columns) of (_id, _text, _more, spans)."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        total, removed, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, gone, rest = without((text or "").encode().split(), spans or [], window)
            total.append(n)
            removed.append(gone)
            kept.append(text if whole and not gone else rest)
        return {"_id": batch.column(0), "n_words": total, "n_removed": removed, "kept": kept, "_more": batch.column(3)}

    rows = docs.select("_id", "_text", "spans", "_more")
    schema = T.StructType([*fields(rows, ["_id"], "n_words bigint, n_removed bigint, kept string"), rows.schema["_more"]])
    out = map_batches(rows, run, schema)
    return out.select("_id.key", "n_words", "n_removed", "kept", *[F.col(f"_more.`{c}`") for c in carry])


def without(words: list[bytes], spans: list[dict], window: int) -> tuple[int, int, str]:
    """Number of words, how many go, and the rest joined; spans are of the first words of windows."""
    kept, at = [], 0
    for first, end in sorted((s["first"], s["last"] + window) for s in spans):
        kept += words[at : max(at, first)]
        at = max(at, end)
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept).decode()
