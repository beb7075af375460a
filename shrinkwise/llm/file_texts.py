"""Texts of the library's file records: contents are bytes, the text operators read text."""

from __future__ import annotations

import codecs
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from shrinkwise.llm.common import fields, map_batches

# Marks at the beginning of a file that name its charset, longer ones first.
MARKS = (
    (codecs.BOM_UTF8, "utf-8"),
    (codecs.BOM_UTF32_LE, "utf-32-le"),
    (codecs.BOM_UTF32_BE, "utf-32-be"),
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
)
#: For bytes.translate: A-Z to a-z; all other ASCII but digits and a-z to a space.
LETTERS_ONLY = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
LETTERS = re.compile(rb"[0-9a-z\x80-\xff]+")


def decode(data: bytes) -> tuple[str, str, str | None]:
    """Text, charset and error of a file's bytes.

    A byte-order mark decides; without one it is UTF-8 if that is valid, else Windows-1252, else Latin-1. Where the
    charset of a mark does not fit, what cannot be decoded becomes U+FFFD and the error says where that began.
    """
    for mark, charset in MARKS:
        if data.startswith(mark):
            try:
                return data[len(mark) :].decode(charset), charset, None
            except UnicodeDecodeError as exc:
                return data[len(mark) :].decode(charset, "replace"), charset, f"{exc.reason} at byte {exc.start + len(mark)}"
    for charset in ("utf-8", "cp1252"):
        try:
            return data.decode(charset), charset, None
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1"), "latin-1", None


def decode_files(files: DataFrame, content: str = "content") -> DataFrame:
    """File records with `text`, `charset` and `decode_error` in the place of their content.

    `files` are records as scan_files reads them with contents; all other columns stay, but for earlier ones of those
    three names. A file without content, too large or unreadable, has a null text and charset. No rows give none.
    """
    kept = [c for c in files.columns if c not in (content, "text", "charset", "decode_error")]

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = [(None, None, None) if d is None else decode(d) for d in batch.column(len(kept)).to_pylist()]
        return {**{c: batch.column(i) for i, c in enumerate(kept)}, **{c: [f[i] for f in found] for i, c in enumerate(("text", "charset", "decode_error"))}}

    return map_batches(files.select(*kept, content), run, fields(files, kept, "text string, charset string, decode_error string"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text, without decoding it; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]
