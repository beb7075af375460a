"""Benchmark items inside texts: one Aho-Corasick automaton over windows of their words."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches, saved_texts
from shrinkwise.llm.file_texts import LETTERS, LETTERS_ONLY, text_bytes
from shrinkwise.session import saved_table

WINDOW = 10
#: Windows, bytes of them and words in them that one automaton holds: what is broadcast at a time.
AUTOMATON_WINDOWS = 100_000
AUTOMATON_BYTES = 32 << 20
AUTOMATON_WORDS = 1_000_000  # There are 1,112,064 characters.
#: Stands in a coded text for every word that no window has.
OTHER = chr(1)


def mark_contaminated(
    files: DataFrame,
    items: DataFrame,
    rel_path: str = "rel_path",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    automaton_windows: int = AUTOMATON_WINDOWS,
) -> DataFrame:
    """Where words of test questions and answers occur in files.

    `files` are file records with their text (decode_files makes it from contents); `items` are the questions and
    answers, general records of an id and a text, as the library has none of its own. Words are stretches of ASCII
    letters, digits and all non-ASCII characters, A-Z lower-cased. Every `window` consecutive words of an item are a
    window; an item with fewer words is one window, one without words none. Returns a row per file:
    (rel_path, n_words, n_hit, items, spans, contaminated). n_hit counts the words inside occurrences of windows, items are the ids
    of items with such windows, distinct, as text and sorted, spans are the stretches of hit words as code points
    (start, stop) of the text as it was given.

    Every word that a window has becomes one character, every other word one common character, so a text is scanned
    once by the automaton, and a match's end is the number of its last word. The windows are a table; an automaton
    takes at most about `automaton_windows` of them and AUTOMATON_BYTES, and is broadcast. If there are more, the texts
    are scanned once for each such block, with the hits so far kept beside each text in the shared folder.

    Null texts, of files and items, have no words. Windows of an item whose id is null hit words, but add no item.
    Items that share an id are one item. Rows that share a rel_path, or have none, are judged each on its own; rel_path
    may be any column, also a struct. Other columns are ignored. No files give no rows; without items nothing is hit.
    """
    windows = saved_table(item_windows(items, item_id, item_text, window), "windows")
    n, size = windows.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    blocks = max(1, -(-n // automaton_windows), -(-size // AUTOMATON_BYTES), -(-n * window // AUTOMATON_WORDS))
    numbered = windows.withColumn("_block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    result = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:bigint,stop:bigint>>, contaminated boolean"
    rows = files.select(F.col(rel_path).alias("key"), F.col(text).alias("text"), F.array().cast("array<string>").alias("items"), F.array().cast("array<bigint>").alias("hit"))
    for block in range(blocks):
        held = numbered.where(F.col("_block") == block).select("window", "item").toArrow()
        known = files.sparkSession.sparkContext.broadcast(Windows(held.column(0).to_pylist(), held.column(1).to_pylist()))
        if block + 1 < blocks:
            rows = saved_texts(map_batches(rows, lambda batch, of=known: _hits(batch, of.value), rows.schema), "hits")
    schema = fields(files, [rel_path], result)

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = _hits(batch, known.value)
        spans = [character_spans(t, h) if h else [] for t, h in zip(text_bytes(found["text"]), found["hit"], strict=True)]
        n_hit = [sum(h[1::2]) - sum(h[::2]) for h in found["hit"]]
        return {
            rel_path: found["key"], "n_words": found["n_words"], "n_hit": n_hit, "items": found["items"],
            "spans": spans, "contaminated": [k > 0 for k in n_hit],
        }

    return map_batches(rows, run, schema)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LETTERS_ONLY).split()


def item_windows(items: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Distinct (window, item): the words of every window of every item, joined by single spaces."""

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        found = []
        for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
            words = words_of(text)
            found += [(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words]
        return {"window": [f[0] for f in found], "item": [f[1] for f in found]}

    rows = items.select(F.col(item_id).cast("string"), F.col(item_text))
    schema = fields(rows, [], "window string, item string")
    return map_batches(rows, run, schema).distinct()


class Windows:
    """Windows with the items that have them; every worker process makes the automaton once."""

    def __init__(self, windows: list[str], items: list[str | None]):
        self.items: dict[str, list[str | None]] = {}
        for w, item in zip(windows, items, strict=True):
            self.items.setdefault(w, []).append(item)
        self.automaton = None

    def __getstate__(self) -> dict[str, object]:
        return {"items": self.items, "automaton": None}

    def _build(self) -> None:
        import ahocorasick

        self.automaton, self.codes, self.of = ahocorasick.Automaton(), {}, []
        for window, items in self.items.items():
            words = window.encode().split(b" ")
            for w in words:
                if w not in self.codes:
                    n = len(self.codes) + 2
                    self.codes[w] = chr(n if n < 0xD800 else n + 0x800)  # Surrogates are no characters.
            self.automaton.add_word("".join([self.codes[w] for w in words]), (len(words), len(self.of)))
            self.of.append([i for i in items if i is not None])
        self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Stretches of words (first, behind the last) that occurrences of windows cover, and the windows' numbers."""
        if not self.items:
            return [], set()
        if self.automaton is None:
            self._build()
        coded = "".join(map(self.codes.get, words, repeat(OTHER)))
        stretches: list[tuple[int, int]] = []
        numbers = set()
        for end, (size, number) in self.automaton.iter(coded):
            stretches.append((end + 1 - size, end + 1))
            numbers.add(number)
        return stretches, numbers


def _hits(batch: pa.RecordBatch, windows: Windows) -> dict[str, object]:
    """The rows with the items and hit words that these windows add; hit words are firsts and ends, in turn."""
    items, hits, n_words = [], [], []
    before_items, before_hits = batch.column(2).to_pylist(), batch.column(3).to_pylist()
    for text, known, hit in zip(text_bytes(batch.column(1)), before_items, before_hits, strict=True):
        words = words_of(text)
        stretches, numbers = windows.find(words)
        n_words.append(len(words))
        hits.append(_merged(stretches + list(zip(hit[::2], hit[1::2], strict=True))) if stretches else hit)
        items.append(sorted({*known, *(i for n in numbers for i in windows.of[n])}) if numbers else known)
    return {"key": batch.column(0), "text": batch.column(1), "items": items, "hit": hits, "n_words": n_words}


def _merged(stretches: list[tuple[int, int]]) -> list[int]:
    """Stretches put together where they touch, as a flat list in order."""
    out: list[int] = []
    for first, end in sorted(stretches):
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def character_spans(text: bytes, hit: list[int]) -> list[dict[str, int]]:
    """Code points of the given text where stretches of hit words begin and end."""
    offsets = np.array([m.span() for m in LETTERS.finditer(text.translate(LETTERS_ONLY))])
    first_bytes = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
    points = np.concatenate([[0], np.cumsum(first_bytes)])
    return [{"start": int(points[offsets[a][0]]), "stop": int(points[offsets[b - 1][1]])} for a, b in zip(hit[::2], hit[1::2], strict=True)]
