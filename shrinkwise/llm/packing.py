"""Packing texts into token sequences: first-fit decreasing with a tournament tree, per random group."""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.session import saved_table

CAPACITY = 4096
#: Id put after every text.
END_ID = 2
#: Pieces in a group, about: a group is packed by one call and knows only lengths.
GROUP_PIECES = 8192
#: Encoded words a worker remembers before it starts anew.
REMEMBERED_WORDS = 3 << 19
_WORD = re.compile(r"[^ \t-\r]+")
_SEPARATOR = re.compile(r"[\x1c-\x1f]")
# Letters whose lower case is one letter, without marks that combine and without white space.
_PLAIN = re.compile(r"[!-~\u00a1-\u012f]+")
#: Parts encoded by one call.
GROUP_PARTS = 256
# The tokenizer's own splitting rule, a fixed value.
_PART = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def pack_files(
    files: DataFrame,
    tokenizer: str,
    rel_path: str = "rel_path",
    text: str = "text",
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Packs every file's token ids, END_ID last, into sequences of at most `capacity` ids.

    Returns a row per piece: (rel_path, start, length, ids_crc32, doc_tokens, sequence_id, offset). A text is
    cut after every `capacity` ids, so all pieces but a text's last fill a sequence. Pieces are numbered and dealt into
    random groups by a hash of their numbers, about `group_pieces` in each also where rel_path repeats, and each group is packed by
    first-fit decreasing: longest piece first, into the first sequence with room, which a tournament tree
    over the rooms finds in logarithmic time. Offsets run without gaps from 0; padding follows the pieces
    and comes to less than one sequence in a group besides what no piece fits.

    `tokenizer` is the path of the tokenizers file with words and word ends, which splits at white space; every
    distinct word, and part of a word by the file's splitting rule, is encoded once and remembered. A null or empty text is END_ID alone. Rows that share a rel_path are
    packed each on its own, as are rows where it is null; other columns are ignored. No rows give none.
    """
    pieces = saved_table(_pieces(files, tokenizer, rel_path, text, capacity), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    numbered = pieces.select(F.monotonically_increasing_id().alias("_piece"), rel_path, "start", "length", "ids_crc32", "doc_tokens")
    group = F.pmod(F.xxhash64("_piece"), F.lit(groups))
    schema = fields(pieces, [rel_path], "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # In the order of numbers, so that a task that is run again packs alike.
        rows = pa.Table.from_batches(list(batches)).sort_by("_piece").drop_columns(["_piece"])
        lengths, at = rows.column("length").to_numpy(), rows.column("_group")[0].as_py()
        bins, offsets = first_fit_decreasing(lengths, capacity)
        out = rows.drop_columns(["_group"])
        out = out.append_column("sequence_id", pa.array((np.int64(at) << 32) + bins, pa.int64()))
        yield from out.append_column("offset", pa.array(offsets, pa.int64())).to_batches()

    return numbered.withColumn("_group", group).groupBy("_group").applyInArrow(pack, schema)


def _pieces(files: DataFrame, tokenizer: str, rel_path: str, text: str, capacity: int) -> DataFrame:
    """(rel_path, start, length, ids_crc32, doc_tokens) with every text cut at multiples of the capacity."""

    # A worker process keeps its copy of this through all of its tasks: the tokenizer is read once, and what one task
    # has encoded, the next one knows.
    known = files.sparkSession.sparkContext.broadcast([])

    def remembered() -> Remembered:
        if not known.value:
            known.value.append(Remembered(tokenizer))
        return known.value[0]

    def run(batch: pa.RecordBatch, words: Remembered) -> dict[str, object]:
        rows, out = [], []
        for i, code in enumerate(words.encode([t or "" for t in batch.column(1).to_pylist()])):
            ids = code + END_ID.to_bytes(4, "little")
            for at in range(0, len(ids), 4 * capacity):
                piece = ids[at : at + 4 * capacity]
                rows.append(i)
                out.append((at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
        columns = dict(zip(("start", "length", "ids_crc32", "doc_tokens"), np.array(out, np.int64).T, strict=True))
        return {rel_path: batch.column(0).take(pa.array(rows, pa.int64())), **columns}

    schema = fields(files, [rel_path], "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")
    return map_batches(files.select(rel_path, text), run, schema, remembered)


class Remembered:
    """Ids of texts as little-endian 32-bit integers; every distinct word is encoded once and kept in `words`.

    ASCII white space always separates words of the tokenizer's own splitting rule, so a text's ids are those
    of its words in order. Words of plain Latin letters and signs, lower-cased as the tokenizer does, fall
    into the rule's parts, which are words themselves; any other word is encoded as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For parts, which are lower-cased and split already; blanks stand between them.
        self.part_tokenizer = Tokenizer(self.tokenizer.model)
        self.part_tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        vocabulary, suffix = self.part_tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.words: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED_WORDS:
            self.words.clear()
        # str.split also splits at four separators that are no white space to the tokenizer.
        split = [_WORD.findall(t) if _SEPARATOR.search(t) else t.split() for t in texts]
        codes = [list(map(self.words.get, words)) for words in split]
        gaps = [list(compress(range(len(found)), map(is_, found, repeat(None)))) for found in codes]
        self._learn({words[i] for words, gap in zip(split, gaps, strict=True) for i in gap})
        for words, found, gap in zip(split, codes, gaps, strict=True):
            for i in gap:
                found[i] = self.words[words[i]]
        return [b"".join(found) for found in codes]

    def _learn(self, new: set[str]) -> None:
        letters = {w for w in new if w.islower() and w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w))}
        new -= letters
        odd = [w for w in new if not _PLAIN.fullmatch(w) or "<|" in w]
        self._keep_words(odd)
        # Letters with signs behind them are the commonest shape: two parts, found without the rule.
        heads, tails, several = {}, set(), {}
        for word in new.difference(odd):
            lower = word.lower()
            head = lower.rstrip(string.punctuation)
            if head.isalpha():
                heads[word] = head
                tails.add(lower[len(head) :])
            else:
                several[word] = _PART.findall(lower)
        tails.discard("")
        self._keep_parts(list(letters.union(heads.values(), tails, *several.values()).difference(self.words)))
        for word, head in heads.items():
            code = self.words[head]
            self.words[word] = code + self.words[word[len(head) :]] if len(head) < len(word) else code
        for word, parts in several.items():
            self.words[word] = b"".join([self.words[p] for p in parts])

    def _keep_words(self, words: list[str]) -> None:
        for word, code in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.words[word] = array("I", code.ids).tobytes()

    def _keep_parts(self, parts: list[str]) -> None:
        """Many parts are encoded as one text: the last id of each, and no other, is a word's end."""
        for first in range(0, len(parts), GROUP_PARTS):
            group = parts[first : first + GROUP_PARTS]
            (code,) = self.part_tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)
            ids = np.array(code.ids, np.uint32)
            ends = (4 * np.flatnonzero(self.word_end[ids]) + 4).tolist()
            data = ids.tobytes()
            for part, start, end in zip(group, [0, *ends[:-1]], ends, strict=True):
                self.words[part] = data[start:end]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and its place there: longest first, ties in the given order.

    A tournament tree keeps the largest room of every range of bins; from the root the way goes left
    wherever the room there is enough, which ends at the first bin that fits.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    for item in np.argsort(-lengths, kind="stable").tolist():
        size, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets
