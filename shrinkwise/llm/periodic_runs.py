"""Periodic runs of words: a suffix automaton whose suffix links form a link-cut tree of last occurrences."""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.llm.file_texts import text_bytes

#: Words that a run has at least.
MIN_LENGTH = 12
#: Odd multipliers of hashes of word groups come from this seed; what they decide is exact for any.
SEED = 12


def find_periodic_runs(files: DataFrame, rel_path: str = "rel_path", text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """All periodic runs of words of every file, and its text without the repetitions.

    `files` are file records with their text (decode_files makes it from contents). Words are separated by ASCII white
    space and compared as they are. A run is a stretch of consecutive words with smallest period q (words q apart are
    identical), at least max(`min_length`, 2 q) long, that cannot be made longer at either end with that period.
    Returns a row per file: (rel_path, n_words, runs, collapsed), runs as (start, length, period) by start, then period,
    start as a word's number from 0. collapsed holds the words, joined by single spaces, that no run contains
    behind its first q words.

    Words are appended to a suffix automaton; its suffix links are kept as a link-cut tree, whose segments are the
    states with one last occurrence. Accessing the state of a new word recolours the path to the root; where a
    segment's previous end is no farther away than its longest string, two equal neighbours end here, and that square
    is extended to its run. Words come to the automaton only if they may belong to a run: each group of half of
    `min_length` words in a run also occurs one period earlier or later in it, so stretches without such
    groups are left out, which loses no run. Hashes find the groups; a collision only keeps more words.

    A null text has no words, no runs and an empty collapsed text. Rows that share a rel_path, or have none, are each
    read on their own; rel_path may be any column, also a struct. Other columns are ignored. No rows give none.
    """
    schema = fields(files, [rel_path], "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        split = [t.split() for t in text_bytes(batch.column(1))]
        runs = runs_of_all(split, min_length)
        collapsed = [b" ".join(kept_words(w, r) if r else w) for w, r in zip(split, runs, strict=True)]
        shown = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
        return {rel_path: batch.column(0), "n_words": [len(w) for w in split], "runs": shown, "collapsed": collapsed}

    return map_batches(files.select(rel_path, text), run, schema)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains behind its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def runs_of_all(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, in order."""
    kinds: dict[bytes, int] = {}
    ids = np.array([kinds.setdefault(w, len(kinds)) for w in chain.from_iterable(texts)], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end in candidate_stretches(ids, np.repeat(np.arange(len(texts)), sizes), min_length):
        owner = int(np.searchsorted(first, start, side="right")) - 1
        words = np.unique(ids[start:end], return_inverse=True)[1].tolist()
        found[owner] += [(start - int(first[owner]) + s, n, q) for s, n, q in periodic_runs(words, min_length)]
    return [sorted(f) for f in found]


def candidate_stretches(ids: np.ndarray, owner: np.ndarray, min_length: int) -> list[tuple[int, int]]:
    """Stretches (first word, behind the last) outside of which there is no run; none reaches over two owners.

    In each round the owners are the stretches found before, so that groups must repeat nearer and nearer.
    """
    size = max(1, (min_length + 1) // 2)
    if len(ids) < min_length:
        return []
    multipliers = np.random.default_rng(SEED).integers(1 << 62, size=size + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    places = len(ids) - size + 1
    group = np.zeros(places, np.uint64)
    for k in range(size):
        group += ids[k : k + places].astype(np.uint64) * multipliers[k]
    group ^= group >> np.uint64(29)
    covered_before = len(ids) + 1
    while True:
        at = np.flatnonzero((owner[:places] == owner[size - 1 :]) & (owner[:places] >= 0))
        key = group[at] + owner[at].astype(np.uint64) * multipliers[size]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        repeated = at[counts[inverse] > 1]
        change = np.zeros(len(ids) + 1, np.int64)
        np.add.at(change, repeated, 1)
        np.add.at(change, repeated + size, -1)
        covered = np.cumsum(change[:-1]) > 0
        # A stretch ends where the cover does, or where the next owner begins.
        begins = covered & np.concatenate([[True], ~covered[:-1] | (owner[1:] != owner[:-1])])
        ends = covered & np.concatenate([~covered[1:] | (owner[1:] != owner[:-1]), [True]])
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        long = stops - starts >= min_length
        starts, stops = starts[long], stops[long]
        total = int((stops - starts).sum())
        if total == covered_before or not total:
            return list(zip(starts.tolist(), stops.tolist(), strict=True))
        covered_before = total
        owner = np.full(len(ids), -1, np.int64)
        change = np.zeros(len(ids) + 1, np.int64)
        change[starts] += np.arange(len(starts)) + 1
        change[stops] -= np.arange(len(starts)) + 1
        owner = np.cumsum(change[:-1]) - 1


def periodic_runs(words: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of word numbers.

    States are numbered from 1, the root; 0 is no state. Every segment of the link-cut tree is a splay tree ordered by depth, and
    the colour of its root is where the segment's strings ended last.
    """
    n = len(words)
    most = 2 * n + 2
    link, length = array("i", bytes(4 * most)), array("i", bytes(4 * most))
    # A state's first way on is in two arrays; few states have more.
    way_word, way_to = array("i", [-1]) * most, array("i", bytes(4 * most))
    more: dict[int, dict[int, int]] = {}
    parent, left, right = (array("i", bytes(4 * most)) for _ in range(3))
    colour = array("i", [-1]) * most
    end_of: dict[int, int] = {}
    out: list[tuple[int, int, int]] = []

    def splay(x: int) -> None:
        """Makes x the root of its segment's tree; colour and way to the next segment go with the root."""
        while True:
            p = parent[x]
            if not p:
                return
            if left[p] == x:
                x_left = True
            elif right[p] == x:
                x_left = False
            else:
                return
            g = parent[p]
            inner = g and (left[g] == p or right[g] == p)
            if inner:
                top = parent[g]
                if (left[g] == p) == x_left:
                    # p over g, then x over p.
                    if x_left:
                        b, c = right[x], right[p]
                        right[x], left[p], right[p], left[g] = p, b, g, c
                    else:
                        b, c = left[x], left[p]
                        left[x], right[p], left[p], right[g] = p, b, g, c
                    if b:
                        parent[b] = p
                    if c:
                        parent[c] = g
                    parent[p], parent[g] = x, p
                else:
                    b, c = left[x], right[x]
                    if x_left:
                        left[x], right[x], right[g], left[p] = g, p, b, c
                        if b:
                            parent[b] = g
                        if c:
                            parent[c] = p
                    else:
                        left[x], right[x], right[p], left[g] = p, g, b, c
                        if b:
                            parent[b] = p
                        if c:
                            parent[c] = g
                    parent[p] = parent[g] = x
                old = g
            else:
                top, old = g, p
                if x_left:
                    b = right[x]
                    right[x], left[p] = p, b
                else:
                    b = left[x]
                    left[x], right[p] = p, b
                if b:
                    parent[b] = p
                parent[p] = x
            parent[x] = top
            if top:
                if left[top] == old:
                    left[top] = x
                elif right[top] == old:
                    right[top] = x
            colour[x] = colour[old]

    last = states = 1
    for i, word in enumerate(words):
        states += 1
        new = states
        length[new] = length[last] + 1
        p = last
        while p:
            if way_word[p] == -1:
                way_word[p], way_to[p] = word, new
            elif way_word[p] == word or (p in more and word in more[p]):
                break
            else:
                more.setdefault(p, {})[word] = new
            p = link[p]
        if not p:
            link[new] = 1
        else:
            q = way_to[p] if way_word[p] == word else more[p][word]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                states += 1
                clone = states
                length[clone], link[clone] = length[p] + 1, link[q]
                way_word[clone], way_to[clone] = way_word[q], way_to[q]
                if q in more:
                    more[clone] = dict(more[q])
                while p:
                    if way_word[p] == word:
                        if way_to[p] != q:
                            break
                        way_to[p] = clone
                    elif p in more and more[p].get(word) == q:
                        more[p][word] = clone
                    else:
                        break
                    p = link[p]
                link[q] = link[new] = clone
                # The clone's strings ended last where those of q did: it joins that segment, right above q.
                splay(q)
                above = left[q]
                left[q], parent[clone], left[clone] = clone, q, above
                if above:
                    parent[above] = clone
        parent[new] = link[new]
        last = new

        x, below = new, 0
        while x:
            splay(x)
            ended = colour[x]
            if right[x]:
                colour[right[x]] = ended
            period = i - ended
            if ended >= 0 and period <= length[x] and i >= end_of.get(period, 0):
                start, end = i - 2 * period + 1, i + 1
                while start and words[start - 1] == words[start - 1 + period]:
                    start -= 1
                while end < n and words[end] == words[end - period]:
                    end += 1
                end_of[period] = end
                if end - start >= min_length:
                    out.append((start, end - start, period))
            right[x] = below
            below, x = x, parent[x]
        colour[below] = i
    return out
