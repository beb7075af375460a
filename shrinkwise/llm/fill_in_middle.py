"""Fill-in-the-middle forms of texts by block rotation in place, and back."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.llm.file_texts import text_bytes

# What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes that a reversal exchanges at a time: what it needs besides the buffer itself.
EXCHANGED = 1 << 16


def fill_in_middle(files: DataFrame, rel_path: str = "rel_path", text: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """Cuts every file's text into prefix, middle and suffix at line ends and puts the middle last.

    `files` are file records with their text (decode_files makes it from contents). Returns a row per row:
    (rel_path, n, form, prefix_chars, middle_chars, output). n is the number of lines, each with its line feed. The two
    cuts and the form follow from the SHA-256 of `seed:rel_path`, so they are the same in every run and on every
    executor. `fim_percent` of the texts are rotated, `spm_percent` of those into suffix, prefix, middle ("spm"), the
    others into prefix, suffix, middle ("psm"), each part behind its sentinel. The rest stay as they are ("plain"),
    as do empty texts and those that contain a sentinel, so that restore_files gets every text back exactly. The two
    sizes are code points, null where the text is plain.

    A text is one buffer: sentinels are inserted at the cuts, and the two blocks that change places are exchanged by
    three reversals within it. A null text is empty. Rows that share a rel_path are cut alike if their texts are; a null
    rel_path counts as empty. rel_path may be any column, also a struct. Other columns are ignored. No rows give none.
    """
    schema = fields(files, [rel_path], "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        keys = batch.column(2).to_pylist()
        rows = [rearranged(t, draws(seed, k or ""), fim_percent, spm_percent) for t, k in zip(text_bytes(batch.column(1)), keys, strict=True)]
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        return {rel_path: batch.column(0), **{c: [r[i] for r in rows] for i, c in enumerate(names)}}

    return map_batches(files.select(rel_path, text, F.col(rel_path).cast("string").alias("_seeded")), run, schema)


def restore_files(rearranged: DataFrame, rel_path: str = "rel_path", form: str = "form", output: str = "output") -> DataFrame:
    """(rel_path, text) of fill_in_middle's output: rotations are inverted and sentinels removed, from form and output alone.

    A null output is an empty text; an output that lacks the sentinels of its form is an error. Other columns are
    ignored; rel_path may be any column, also a struct.
    """

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        texts = [restored(o, f) for o, f in zip(text_bytes(batch.column(2)), batch.column(1).to_pylist(), strict=True)]
        return {rel_path: batch.column(0), "text": texts}

    return map_batches(rearranged.select(rel_path, form, output), run, fields(rearranged, [rel_path], "text string"))


def draws(seed: int, key: str) -> list[int]:
    """Four unsigned 32-bit numbers that belong to a key."""
    return np.frombuffer(hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16], ">u4").tolist()


def rotate(view: np.ndarray, first: int, middle: int, last: int) -> None:
    """Exchanges the blocks first..middle and middle..last within the buffer by three reversals."""
    _reverse(view, first, middle)
    _reverse(view, middle, last)
    _reverse(view, first, last)


def _reverse(view: np.ndarray, first: int, last: int) -> None:
    while last - first > 1:
        n = min(EXCHANGED, (last - first) // 2)
        ahead = view[first : first + n][::-1].copy()
        view[first : first + n] = view[last - n : last][::-1]
        view[last - n : last] = ahead
        first, last = first + n, last - n


def line_ends(data: bytes) -> np.ndarray:
    """Offset behind every line, the last one also without a line feed."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.append(ends, len(data)) if data and not data.endswith(b"\n") else ends


def code_points(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def rearranged(data: bytes, drawn: list[int], fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, bytes]:
    """Lines, form, code points of prefix and middle, and the output for one text."""
    ends = line_ends(data)
    n = len(ends)
    if not data or drawn[2] % 100 >= fim_percent or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, data
    cuts = [int(ends[unit - 1]) if unit else 0 for unit in sorted(d % (n + 1) for d in drawn[:2])]
    buffer = bytearray(data)
    for at, sentinel in ((cuts[1], SUFFIX), (cuts[0], MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = cuts[0] + len(PREFIX), cuts[1] + len(PREFIX + MIDDLE)
    form = SPM if drawn[3] % 100 < spm_percent else PSM
    rotate(np.frombuffer(buffer, np.uint8), middle if form == PSM else 0, suffix, len(buffer))
    return n, form, code_points(data[: cuts[0]]), code_points(data[cuts[0] : cuts[1]]), bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text behind an output: its blocks go back where they were, then the sentinels go."""
    if form == PLAIN:
        return output
    buffer = bytearray(output)
    first, second = (buffer.index(s) for s in ((SUFFIX, MIDDLE) if form == PSM else (SUFFIX, PREFIX)))
    rotate(np.frombuffer(buffer, np.uint8), first, second, len(buffer))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + len(sentinel)]
    return bytes(buffer)
