"""Packing and piece encoding against the tokenizers' own results."""

import os
import random
import zlib
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
import sentencepiece
from tokenizers import Tokenizer

from shrinkwise.llm.packing import Remembered, first_fit_decreasing, pack_files
from shrinkwise.llm.piece_codec import END, START, Encoder, best_path, chunk_bounds, decode_files, encode_files, load_piece_model, marked, product

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "aAzZ'sSTtdDlLmMreVv09 \t\n\x0b\x1c\x85\xa0éÉßİıΣςσ²½ªº_-!<|>endoftext́HЖж漢字🙂​﻿▁"


def random_texts(n, letters=LETTERS):
    rng = random.Random(5)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_remembered_words_give_the_tokenizers_ids():
    texts = [*random_texts(3000), "x<|endoftext|>y", "it's they'LL we'Ve", "d'd''s", ""]
    tokenizer = Tokenizer.from_file(WORDS)
    for text, code in zip(texts, Remembered(WORDS).encode(texts), strict=True):
        assert np.frombuffer(code, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_words_with_signs_are_parts_encoded_many_at_a_time():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéßstmv") for _ in range(rng.randint(1, 9))) + rng.choice(["", "'", ".'", "$$", "',s", "'s", "</w>", "²."]) for _ in range(4000)]
    words = [rng.choice([w, w.capitalize(), w.upper(), "'" + w]) for w in words]
    known, asked = Remembered(WORDS), []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    known.part_tokenizer = Counting(known.part_tokenizer)
    tokenizer = Tokenizer.from_file(WORDS)
    for _ in range(2):
        (code,) = known.encode([" ".join(words)])
        assert np.frombuffer(code, "<u4").tolist() == tokenizer.encode(" ".join(words), add_special_tokens=False).ids
        assert 0 < len(asked) < 20


def test_a_worker_process_reads_the_tokenizer_once(spark, tmp_path, monkeypatch):
    read = tmp_path / "read"
    original = Remembered.__init__

    def noted(self, path):
        original(self, path)
        with read.open("a") as out:
            out.write(f"{os.getpid()}\n")

    monkeypatch.setattr(Remembered, "__init__", noted)
    files = spark.range(64).repartition(64).select(F.col("id").alias("rel_path"), F.lit("a text").alias("text"))
    assert pack_files(files, WORDS).count() == 64
    processes = read.read_text().split()
    assert len(processes) == len(set(processes))


def test_first_fit_decreasing_equals_a_search_from_the_left():
    rng = random.Random(6)
    lengths = np.array([rng.randint(1, 30) for _ in range(300)])
    bins, offsets = first_fit_decreasing(lengths, 32)
    rooms, expected = [], {}
    for item in sorted(range(300), key=lambda i: (-lengths[i], i)):
        at = next((k for k, room in enumerate(rooms) if room >= lengths[item]), len(rooms))
        rooms += [32] if at == len(rooms) else []
        expected[item] = (at, 32 - rooms[at])
        rooms[at] -= lengths[item]
    assert [(b, o) for b, o in zip(bins, offsets, strict=True)] == [expected[i] for i in range(300)]


@pytest.mark.parametrize("group", [8192, 7])
def test_packed_sequences_hold_every_id_once(spark, group):
    texts = [*random_texts(60), "", None, "many words here " * 400]
    files = spark.createDataFrame(list(enumerate(texts)), "rel_path bigint, text string")
    rows = pack_files(files, WORDS, capacity=256, group_pieces=group).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    for i, text in enumerate(texts):
        ids, at = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted((r for r in rows if r.rel_path == i), key=lambda r: r.start):
            piece = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(piece.tobytes()))
            at += r.length
        assert at == len(ids)
    for sequence in {r.sequence_id for r in rows}:
        ends = sorted((r.offset, r.offset + r.length) for r in rows if r.sequence_id == sequence)
        assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]] and ends[-1][1] <= 256


def test_repeated_and_null_paths_are_dealt_over_groups(spark):
    files = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "same").alias("rel_path"), F.concat_ws(" ", F.lit("word"), "id").alias("text"))
    sequences = pack_files(files, WORDS, capacity=64, group_pieces=100).groupBy((F.col("sequence_id") / 2**32).cast("int")).count()
    assert sequences.count() == 30 and sequences.agg(F.max("count")).first()[0] < 160


@pytest.fixture(scope="module")
def model():
    return load_piece_model(PIECES)


def test_paths_equal_the_models_encoding(model):
    reference, encoder = sentencepiece.SentencePieceProcessor(model_file=PIECES), Encoder(model)
    texts = [*random_texts(3000), *random_texts(2000, "  aabeehtoinrsd.\n▁"), *(" " * k for k in range(40)), *("a" * k for k in range(60))]
    for text in texts:
        assert np.frombuffer(encoder.texts([text])[0], np.int32).tolist() == reference.encode(text), text


def test_chunks_combine_to_the_whole(model):
    encoder = Encoder(model)
    for text in [*random_texts(300), *random_texts(300, "aabeehtoinrs "), "abcd" * 100, "the" * 60, "x  y " * 50]:
        s = marked(text)
        for size in (1, 3, 7, 20) if s else ():
            bounds = chunk_bounds(s, size)
            chunks = [(s[max(0, a - 16) : a], s[a:b], s[b : b + 16]) for a, b in zip(bounds, bounds[1:])]
            matrices = [encoder.transfer(*c, i == 0, i == len(chunks) - 1) for i, c in enumerate(chunks)]
            path = best_path(matrices)
            assert reduce(product, matrices) == [(START, END)]
            # Whatever neighbours are multiplied first, the product is the same.
            left = [reduce(product, matrices[at : at + 3]) for at in range(0, len(matrices), 3)]
            assert reduce(lambda b, a: product(a, b), reversed(left)) == [(START, END)]
            ends = [(states[0][0], states[-1][1]) for states in (path[at : at + 3] for at in range(0, len(path), 3))]
            assert best_path(left) == ends
            assert [s for k, e in enumerate(ends) for s in best_path(matrices[3 * k : 3 * k + 3], *e)] == path
            assert b"".join(encoder.trace(c[1], c[2], *states) for c, states in zip(chunks, path, strict=True)) == encoder.texts([text])[0]


@pytest.mark.parametrize("fan", [2, 5, 32])
def test_giant_texts_are_encoded_in_chunks_and_decoded_again(spark, model, fan):
    texts = [*random_texts(30), "word after word " * 300, "oneverylongword" * 200, None, ""]
    files = spark.createDataFrame(list(enumerate(texts)), "rel_path bigint, text string")
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = encode_files(files, model, chunk=100, fan=fan)
    rows, decoded = encoded.collect(), decode_files(encoded, model).collect()
    for i, text in enumerate(texts):
        chunks = sorted((r for r in rows if r.rel_path == i), key=lambda r: r.chunk)
        assert [x for r in chunks for x in r.ids] == reference.encode(text or "")
        assert [r.start for r in chunks] == [sum(len(c.ids) for c in chunks[:k]) for k in range(len(chunks))]
        back = "".join(r.text for r in sorted((r for r in decoded if r.rel_path == i), key=lambda r: r.chunk))
        assert back == (text or "").replace("▁", " ")
    assert sum(r.rel_path == 31 for r in rows) > 20
