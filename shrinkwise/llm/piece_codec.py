"""Encoding and decoding texts with a SentencePiece BPE model: a max-plus scan over chunks of a text."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.session import saved_table

#: Characters of a chunk, about.
CHUNK = 1 << 16
#: No piece is longer than this.
LONGEST = 16
REMEMBERED_WORDS = 5 << 18
#: Neighbouring matrices multiplied in one group.
FAN = 32
SPACE = "▁"
#: States besides pieces: a character without a piece, the start of a text, its end.
BYTES, START, END = (1 << 20) + 1, (1 << 20) + 2, (1 << 20) + 3
#: Where no piece can cross: before a space mark that follows something else.
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Texts in which spaces stand at an end or beside each other, or that have marks of their own.
_UNEVEN = re.compile(f"^ | $|  |{SPACE}")
_SYNC = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


@dataclass(frozen=True)
class PieceModel:
    """What a SentencePiece BPE model's file says, as plain tables.

    Merges happen in the order of rank; `left` and `right` are the parts that a piece is merged from last.
    Pieces of several space marks, which are merged after everything else, are kept apart in `spaces`.
    """

    pieces: list[str]
    ids: dict[str, int]
    rank: list[float]
    left: list[int]
    right: list[int]
    spaces: list[int]
    first_byte: int


def load_piece_model(path: str) -> PieceModel:
    """Reads a model; pieces that merging never makes are left out of `ids`."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    plain = [i for i in range(len(pieces)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    spaces = {len(pieces[i]): i for i in plain if not pieces[i].strip(SPACE)}
    rank = [-model.get_score(i) if len(pieces[i]) > 1 else -1.0 for i in range(len(pieces))]
    every = {pieces[i]: i for i in plain if pieces[i].strip(SPACE) or len(pieces[i]) == 1}
    left, right, ids = [-1] * len(pieces), [-1] * len(pieces), {}
    for text, i in every.items():
        if len(text) == 1 or (parts := _last_merge(text, every, rank)):
            ids[text] = i
            if len(text) > 1:
                left[i], right[i] = parts
    widths = [spaces.get(k, -1) for k in range(max(spaces, default=0) + 1)]
    first_byte = next(i for i in range(len(pieces)) if model.is_byte(i))
    return PieceModel(pieces, ids, rank, left, right, widths, first_byte)


def _last_merge(text: str, every: dict[str, int], rank: list[float]) -> tuple[int, int] | None:
    parts = list(text)
    while len(parts) > 1:
        options = [(rank[i], at) for at in range(len(parts) - 1) if (i := every.get(parts[at] + parts[at + 1])) is not None]
        if not options:
            return None
        at = min(options)[1]
        if len(parts) == 2:
            return (every[parts[0]], every[parts[1]]) if parts[0] in every and parts[1] in every else None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return None


def encode_files(
    files: DataFrame, model: PieceModel, rel_path: str = "rel_path", text: str = "text", chunk: int = CHUNK, fan: int = FAN
) -> DataFrame:
    """Piece ids of every text: (rel_path, chunk, start, ids), a row for each chunk of each input row.

    The ids of all chunks of a text in order are the model's encoding of it: a space mark in front, spaces as
    marks, merges by rank, bytes for characters without a piece. `start` counts the ids of earlier chunks.

    A sequence of pieces is that encoding if and only if every two neighbours stay apart when merged by themselves, so
    encoding is a max-plus path problem with weight 0 for neighbours that stay apart and minus infinity for others.
    Longer texts are split into chunks of about `chunk` characters. A state at a boundary is the piece over or before it
    and how far it reaches beyond; each chunk, in any task, yields its transfer matrix between such states,
    of which only entries of 0 are kept. The product of matrices is associative: `fan` neighbours at a time are
    multiplied, in any task, then as many of those products, until a text has few; on the way back each group learns
    the states at its two ends and hands them on to its members. So a text of any length needs no group larger than
    `fan`. Then every chunk is traced back by itself between its two states. Within a chunk no piece crosses the
    start of a word, so words in between are solved once each and remembered.

    Null and empty texts have one chunk without ids. Rows that share a rel_path are encoded each on its own; to tell
    their chunks apart give a struct with a number as rel_path. Other columns are ignored. No rows give no rows.
    """
    context = files.sparkSession.sparkContext
    shipped, known = context.broadcast(vars(model)), context.broadcast({})
    make = lambda: Encoder(PieceModel(**shipped.value), known.value)
    rows = files.select(F.col(rel_path).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    long = F.length("text") > chunk
    schema = fields(rows, ["key"], "row bigint, chunk bigint, ids array<int>")

    def whole(batch: pa.RecordBatch, encoder: Encoder) -> dict[str, object]:
        codes = encoder.texts(batch.column(1).to_pylist())
        return {"key": batch.column(0), "row": [None] * len(codes), "chunk": [0] * len(codes), "ids": _id_lists(codes)}

    short = map_batches(rows.where(~long), whole, schema, make)
    giants = saved_table(_chunks(rows.where(long), chunk), "chunks")
    matrices = saved_table(map_batches(giants, lambda batch, e: _matrices(batch, e), fields(giants, ["row", "chunk", "chunks"], "pairs array<bigint>"), make), "matrices")
    traced = map_batches(giants.join(_boundary_states(matrices, fan), ["row", "chunk"]), lambda batch, e: _traced(batch, e), schema, make)
    coded = short.select("key", F.lit(0).cast("bigint").alias("chunk"), F.lit(0).cast("bigint").alias("start"), "ids")
    traced = saved_table(traced, "traced")
    counts = traced.select("row", "chunk", F.size("ids").alias("n"))
    earlier = counts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("chunk", "n"))).alias("all"))
    starts = earlier.select("row", F.posexplode(F.transform("all", lambda x: x["n"])).alias("chunk", "n"), "all")
    starts = starts.select("row", F.col("chunk").cast("bigint"), F.aggregate(F.slice("all", F.lit(1), F.col("chunk")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("start"))
    out = coded.union(traced.join(starts, ["row", "chunk"]).select("key", "chunk", "start", "ids"))
    return out.withColumnRenamed("key", rel_path)


def decode_files(encoded: DataFrame, model: PieceModel, rel_path: str = "rel_path") -> DataFrame:
    """Texts of encoded chunks: (rel_path, chunk, start, text); the texts of a file's chunks in order are its text.

    Pieces become their strings and space marks spaces, bytes the characters they spell, without the mark that
    encoding puts in front. A chunk whose bytes spell no text has replacement characters; ids that the model
    lacks, and nulls, stand for nothing. Null ids give an empty text.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(vars(model))

    def setup() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = PieceModel(**shipped.value)
        strings = [p.replace(SPACE, " ").encode() for p in m.pieces]
        strings[:3] = [b"", b"", b""]
        strings[m.first_byte : m.first_byte + 256] = [bytes([b]) for b in range(256)]
        sizes = np.array([*map(len, strings), 0])
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes

    def run(batch: pa.RecordBatch, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict[str, object]:
        letters, starts, sizes = table
        lists = batch.column(3)
        ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ids = np.where((ids >= 0) & (ids < len(sizes) - 1), ids, len(sizes) - 1)
        # All texts at once: where each byte of the result stands in the table of pieces.
        size = sizes[ids]
        ends = np.cumsum(size)
        data = letters[np.repeat(starts[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = []
        for start, a, b in zip(batch.column(2).to_pylist(), bounds, bounds[1:]):
            own = data[a:b]
            texts.append((own[1:] if start == 0 and own[:1] == b" " else own).decode(errors="replace"))
        return {rel_path: batch.column(0), "chunk": batch.column(1), "start": batch.column(2), "text": texts}

    return map_batches(encoded.select(rel_path, "chunk", "start", "ids"), run, fields(encoded, [rel_path], "chunk bigint, start bigint, text string"), setup)


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def _id_lists(codes: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(c) // 4 for c in codes)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(codes), np.int32)))


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """(key, row, chunk, chunks, before, text, after): chunks of the marked texts with what stands next to them."""
    numbered = rows.withColumn("row", F.monotonically_increasing_id())

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        at, out = [], []
        for i, (row, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            bounds = chunk_bounds(s := marked(text), chunk)
            for c, (a, b) in enumerate(zip(bounds, bounds[1:])):
                at.append(i)
                out.append((row, c, len(bounds) - 1, s[max(0, a - LONGEST) : a], s[a:b], s[b : b + LONGEST]))
        names = ("row", "chunk", "chunks", "before", "text", "after")
        return {"key": batch.column(0).take(pa.array(at, pa.int64())), **dict(zip(names, zip(*out), strict=True))}

    schema = fields(rows, ["key"], "row bigint, chunk bigint, chunks bigint, before string, text string, after string")
    return map_batches(numbered.select("key", "row", "text"), run, schema).repartition("row", "chunk")


def chunk_bounds(text: str, chunk: int) -> list[int]:
    """About every `chunk` characters, never between two space marks."""
    bounds = [0]
    while bounds[-1] < len(text):
        b = min(len(text), bounds[-1] + chunk)
        while b < len(text) and text[b - 1] == text[b] == SPACE:
            b += 1
        bounds.append(b)
    return bounds


def _matrices(batch: pa.RecordBatch, encoder: Encoder) -> dict[str, object]:
    rows = batch.to_pylist()
    pairs = [[s for pair in encoder.transfer(r["before"], r["text"], r["after"], r["chunk"] == 0, r["chunk"] == r["chunks"] - 1) for s in pair] for r in rows]
    return {**{c: batch.column(c) for c in ("row", "chunk", "chunks")}, "pairs": pairs}


def _boundary_states(matrices: DataFrame, fan: int) -> DataFrame:
    """(row, chunk, entry, exit): the two states of each chunk on its text's one path with weight 0."""
    group = F.floor(F.col("chunk") / fan).alias("group")
    levels = [matrices.select("row", "chunk", "pairs")]
    most = matrices.agg(F.max("chunks")).first()[0] or 0
    while most > fan:
        products = levels[-1].groupBy("row", group).applyInArrow(_product, "row bigint, chunk bigint, pairs array<bigint>")
        levels.append(saved_table(products, "products"))
        most = -(-most // fan)
    states = None
    for level in reversed(levels):
        members = level.select("row", "chunk", "pairs", group)
        if states is None:
            members = members.select("*", F.lit(START).cast("bigint").alias("entry"), F.lit(END).cast("bigint").alias("exit"))
        else:
            members = members.join(states.withColumnRenamed("chunk", "group"), ["row", "group"])
        inner = members.groupBy("row", "group").applyInArrow(_states, "row bigint, chunk bigint, entry bigint, exit bigint")
        states = saved_table(inner, "states")
    return states


def _neighbours(members: pa.Table) -> tuple[list[dict], list[list[tuple[int, int]]]]:
    rows = sorted(members.to_pylist(), key=lambda r: r["chunk"])
    return rows, [list(zip(r["pairs"][::2], r["pairs"][1::2], strict=True)) for r in rows]


def _product(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
    """The matrix of a group of neighbours, under the group's number."""
    pairs = reduce(product, _neighbours(members)[1])
    schema = pa.schema([("row", pa.int64()), ("chunk", pa.int64()), ("pairs", pa.list_(pa.int64()))])
    return pa.table({"row": [key[0].as_py()], "chunk": [key[1].as_py()], "pairs": [[s for pair in pairs for s in pair]]}, schema=schema)


def product(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Max-plus product of two matrices, each given as its pairs of weight 0."""
    onward: dict[int, list[int]] = {}
    for middle, end in b:
        onward.setdefault(middle, []).append(end)
    return sorted({(entry, end) for entry, middle in a for end in onward.get(middle, ())})


def _states(members: pa.Table) -> pa.Table:
    """The two states of each member of a group, between the group's own."""
    rows, matrices = _neighbours(members)
    path = best_path(matrices, rows[0]["entry"], rows[0]["exit"])
    out = [(r["row"], r["chunk"], *states) for r, states in zip(rows, path, strict=True)]
    return pa.table(dict(zip(("row", "chunk", "entry", "exit"), zip(*out), strict=True)), schema=pa.schema([(c, pa.int64()) for c in ("row", "chunk", "entry", "exit")]))


def best_path(matrices: list[list[tuple[int, int]]], start: int = START, end: int = END) -> list[tuple[int, int]]:
    """Entry and exit of each matrix on the path between two states; a matrix is its pairs of weight 0."""
    reached = [{start}]
    for pairs in matrices:
        reached.append({b for a, b in pairs if a in reached[-1]})
    state, path = end, []
    for pairs, before in zip(reversed(matrices), reversed(reached[:-1]), strict=True):
        entry = next(a for a, b in pairs if b == state and a in before)
        path.append((entry, state))
        state = entry
    return path[::-1]


def _traced(batch: pa.RecordBatch, encoder: Encoder) -> dict[str, object]:
    codes = [encoder.trace(r["text"], r["after"], r["entry"], r["exit"]) for r in batch.to_pylist()]
    return {"key": batch.column("key"), "row": batch.column("row"), "chunk": batch.column("chunk"), "ids": _id_lists(codes)}


class Encoder:
    """Max-plus paths through words and chunks. `words` remembers ids, as 32-bit integers, of words seen before."""

    def __init__(self, model: PieceModel, words: dict[str, bytes] | None = None):
        self.model, self.words = model, {} if words is None else words
        self.apart: dict[int, bool] = {}
        self.mark = model.ids.get(SPACE, -1)
        # A trie: letters lead on, the empty string to a piece that ends there.
        self.trie: dict = {}
        for piece, i in model.ids.items():
            node = self.trie
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = i

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts as 32-bit integers."""
        for memory in (self.words, self.apart):
            if len(memory) > REMEMBERED_WORDS:
                memory.clear()
        # A word of a text with single spaces only is remembered without the mark in front of it.
        plain = [bool(t) and not _UNEVEN.search(t) for t in texts]
        words = [t.split(" ") if p else () for t, p in zip(texts, plain, strict=True)]
        known = self.words
        for word in set().union(*words).difference(known):
            known[word] = self.word(SPACE + word)
        return [b"".join(map(known.__getitem__, w)) if p else self.marked(marked(t)) for t, p, w in zip(texts, plain, words, strict=True)]

    def marked(self, text: str) -> bytes:
        """Ids of a text that starts with a mark, or is empty, and has marks for spaces."""
        known, out = self.words, []
        for word in _WORDS.findall(text):
            key = word[1:] if word[1:2] != SPACE else word
            if (code := known.get(key)) is None:
                code = known[key] = self.word(word)
            out.append(code)
        return b"".join(out)

    def word(self, word: str) -> bytes:
        return self.code(self.path(self.walk(word, 0, START, len(word)), 0, len(word)), word)

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the characters of both pieces ends with just these two.

        Going back in time from both pieces, the one that was merged later (the right one if both are the same
        piece) is undone, and what then meet must not have been due for a merge of their own before that.
        """
        key = a << 21 | b
        if (known := self.apart.get(key)) is not None:
            return known
        m, due, apart = self.model, float("inf"), True
        x, y, first = a, b, True
        while True:
            i = m.ids.get(m.pieces[x] + m.pieces[y])
            if i is not None and (first or m.rank[i] < due):
                apart = False
                break
            first = False
            if m.rank[x] > m.rank[y]:
                due, x = m.rank[x], m.right[x]
            elif m.left[y] >= 0:
                # The pair that meets stands to the left of what y was merged from, and would go first.
                due, y = m.rank[y] + 0.5, m.left[y]
            else:
                break
        self.apart[key] = apart
        return apart

    def walk(self, s: str, at: int, before: int, stop: int) -> dict[int, tuple[int, int]]:
        """From a place, after the piece `before`, the places that pieces reach: end of each piece to (piece, its start).

        Pieces start before `stop` and may end after it. One piece at most ends at each place: the last one of the
        encoding of what is read so far.
        """
        found, trie, apart, n = {at: (before, -1)}, self.trie, self.apart, len(s)
        for i in range(at, stop):
            if (here := found.get(i)) is None:
                continue
            previous, node, j = here[0], trie, i
            if s[i] not in trie:
                found[i + 1] = (BYTES, i)
                continue
            while j < n and (node := node.get(s[j])) is not None:
                j += 1
                if (piece := node.get("")) is not None and j not in found:
                    if previous < BYTES:
                        fits = apart.get(previous << 21 | piece)
                        if fits is None:
                            fits = self.stay_apart(previous, piece)
                        if not fits:
                            continue
                    found[j] = (piece, i)
        return found

    def path(self, found: dict[int, tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
        """(piece, its start) back from a place that a walk has reached."""
        out = []
        while end > start:
            out.append(found[end])
            end = found[end][1]
        return out[::-1]

    def code(self, path: list[tuple[int, int]], s: str) -> bytes:
        """Ids of a path; space marks by themselves are joined as far as there are pieces for it, the first ones first."""
        pieces = [piece for piece, _ in path]
        if BYTES not in pieces and self.mark not in pieces:
            return array("i", pieces).tobytes()
        m, ids, marks = self.model, array("i"), 0
        for piece, at in [*path, (None, 0)]:
            if piece == self.mark:
                marks += 1
                continue
            while marks:
                width = next(k for k in range(min(marks, len(m.spaces) - 1), 0, -1) if m.spaces[k] >= 0)
                ids.append(m.spaces[width])
                marks -= width
            if piece == BYTES:
                ids.extend(m.first_byte + b for b in s[at].encode())
            elif piece is not None:
                ids.append(piece)
        return ids.tobytes()

    def transfer(self, before: str, text: str, after: str, first: bool, last: bool) -> list[tuple[int, int]]:
        """Pairs of entry and exit states of a chunk that a path connects."""
        s, n = text + after, len(text)
        syncs = self._syncs(text)
        ends = self._exits(self.walk(s, syncs[-1], START, n), syncs[-1], n, last) if syncs else []
        out = []
        for entry in [START] if first else self._entries(before, s):
            piece, over = (START, 0) if entry == START else divmod(entry, 32)
            if syncs and over <= syncs[0]:
                if syncs[0] == over or syncs[0] in self.walk(s, over, piece, syncs[0]):
                    out += [(entry, e) for e in ends]
            elif not syncs:
                if over <= n:
                    out += [(entry, e) for e in self._exits(self.walk(s, over, piece, n), over, n, last, piece)]
                else:
                    out.append((entry, piece * 32 + over - n))
        return out

    def trace(self, text: str, after: str, entry: int, end: int) -> bytes:
        """Ids of the pieces that start in a chunk, between two states."""
        s, n = text + after, len(text)
        piece, over = (START, 0) if entry == START else divmod(entry, 32)
        to = n if end == END else n + end % 32
        if over >= to:
            return b""
        syncs = [p for p in self._syncs(text) if p >= over]
        if not syncs:
            return self.code(self.path(self.walk(s, over, piece, n), over, to), s)
        head = self.code(self.path(self.walk(s, over, piece, syncs[0]), over, syncs[0]), s)
        tail = self.code(self.path(self.walk(s, syncs[-1], START, n), syncs[-1], to), s)
        return head + self.marked(s[syncs[0] : syncs[-1]]) + tail

    def _syncs(self, text: str) -> list[int]:
        return [m.start() for m in _SYNC.finditer(text)]

    def _entries(self, before: str, s: str) -> Iterator[int]:
        """States that may stand at a chunk's start: pieces that end there or reach over it."""
        whole, at = before + s, len(before)
        for i in range(max(0, at - LONGEST), at):
            for j in range(at, min(len(whole), i + LONGEST) + 1):
                piece = self.model.ids.get(whole[i:j])
                if piece is not None:
                    yield piece * 32 + j - at
        if before[-1] not in self.trie:
            yield BYTES * 32

    def _exits(self, found: dict[int, tuple[int, int]], start: int, n: int, last: bool, before: int = START) -> list[int]:
        if last:
            return [END] if n in found else []
        return [(piece if i >= 0 else before) * 32 + j - n for j, (piece, i) in found.items() if j >= n]
