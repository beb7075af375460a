"""Main text of pages and licence findings on hand-made cases."""

import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shrinkwise.llm.licenses import NAMES, RULES, SENTENCES, known_sentences, scan, scan_licenses
from shrinkwise.llm.main_text import PATH_SIZE, WORD_SIZE, Vectors, _hashed, extract_main_text, fit_block_labeller
from shrinkwise.llm import main_text
from shrinkwise.llm.page_blocks import Block, PathTree, page_blocks
from shrinkwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TEXT = "A sentence of the article with a good number of words in it."


def test_blocks_decode_join_and_split():
    html = "<ul><li>one<li>two &amp; &eacute;</ul><p>a <b>b</b>\n c<br>d<p>e<script>var x='<p>no</p>'</script><!-- no --><div>f</div>g"
    assert [b.text for b in page_blocks(html)] == ["one", "two & é", "a b c d", "e", "f", "g"]
    assert [b.path.tokens for b in page_blocks(html)[:3]] == [("li",), ("li",), ("p",)]
    assert page_blocks(None) == [] and page_blocks("<p>") == []


@pytest.fixture(scope="module")
def labeller(spark):
    pages = spark.read.parquet(f"{SF_DIR}/../sf0.01/pages.parquet")
    return fit_block_labeller(pages.selectExpr("page_id rel_path", "html content"))


@pytest.mark.parametrize(("opening", "closing"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>")])
def test_other_templates(spark, labeller, opening, closing):
    html = (
        '<html><head><title>t</title></head><body><header>Site name</header><nav><a href="/">Home</a><a href="/x">More</a></nav>'
        f'<div class="cookie-notice">We use cookies for a better site.</div>{opening}<h1>Heading</h1><p>{TEXT}</p><p>Short.</p>{closing}'
        '<aside class="sidebar"><p>Other articles to read today</p></aside><form><label>Your mail</label><button>Send</button></form>'
        f'<section class="comments"><h2>Comments</h2><p>{TEXT}</p></section><footer>All rights reserved</footer></body></html>'
    )
    files = spark.createDataFrame([("a.html", html)], "rel_path string, content string")
    assert extract_main_text(files, labeller).first().text == f"Heading\n{TEXT}\nShort."


def test_a_long_page_in_turns_has_the_labels_of_one_turn(labeller, monkeypatch):
    rng = np.random.default_rng(1)
    parts = ["<nav><a>Menu</a></nav>", f"<article><p>{TEXT}</p>", "</article>", f"<aside><p>{TEXT}</p></aside>", f"<div>{TEXT}</div>"]
    pages = [page_blocks("".join(rng.choice(parts, size=n))) for i in range(4) for n in (3, 40, 900)]
    whole = labeller.labels(pages, main_text.Vectors())
    for most in (7, 64, 1000):
        monkeypatch.setattr(main_text, "BLOCKS_AT_ONCE", most)
        again = labeller.labels(pages, main_text.Vectors())
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))


@pytest.mark.parametrize("shape", ["unclosed", "deep list", "long"])
def test_memory_and_time_are_in_proportion_to_a_page(labeller, shape):
    html = {
        "unclosed": '<div class="c">x ' * 20_000,
        "deep list": "<ul>" + "<b>" * 20_000 + "<li>x</li>" * 20_000,
        "long": "<p>some words here.</p>" * 20_000,
    }[shape]
    started, vectors = time.monotonic(), main_text.Vectors()
    tracemalloc.start()
    blocks = page_blocks(html, vectors.tree)
    labels = labeller.labels([blocks], vectors)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == len(blocks) == 20_000
    assert peak < 60e6 and time.monotonic() - started < 120


def test_training_takes_bounded_excerpts_of_repeated_huge_pages(spark):
    page = "<article><p>" + "many words " * 40_000 + "</p></article>" + "<div>" * 3000 + "deep"
    files = spark.range(60).select(F.lit("same.html").alias("rel_path"), F.lit(page).alias("content"))
    seen = []
    labeller = fit_block_labeller(files, sample_pages=8)
    assert labeller.weights
    original, main_text._train = main_text._train, lambda pages, tree: seen.append(pages)
    try:
        fit_block_labeller(files, sample_pages=8)
    finally:
        main_text._train = original
    assert len(seen[0]) == 8 and max(len(b.text) for p in seen[0] for b in p) <= main_text.SAMPLE_CHARS


def test_bytes_of_scanned_pages_are_decoded(spark, labeller):
    html = f"<html><body><article><p>{TEXT} naïve</p></article></body></html>"
    files = spark.createDataFrame([("a", html.encode()), ("b", html.encode("cp1252")), ("c", None)], "rel_path string, content binary")
    assert {r.rel_path: r.text for r in extract_main_text(files, labeller).collect()} == {"a": f"{TEXT} naïve", "b": f"{TEXT} naïve", "c": ""}


def test_given_pages_keep_their_articles(spark):
    rows = QUERIES["op8_main_text"](spark, SF_DIR).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = [b.text for b in page_blocks(pages[r.page_id]) if ("article",) in b.path.tags()]
        assert r.text == "\n".join(inside) and r.n_chars == len(r.text)


def test_a_block_is_known_by_all_of_its_words():
    path, filler = PathTree().path((("html",), ("body",), ("div",))), " ".join(f"w{i % 50}" for i in range(60_000))
    vectors = Vectors()
    one, other, again = (vectors.blocks([Block(f"{filler} {end}", path, 0)])[0] for end in ("cookie", "advert", "cookie"))
    assert (one != other).any() and (one == again).all()
    words = [f"x{i}" for i in range(200)] * 2
    mean = sum(_hashed([w], WORD_SIZE)[0].astype(int) for w in words) / (4 * len(words))
    assert np.allclose(vectors.blocks([Block(" ".join(words), path, 0)])[0][PATH_SIZE : PATH_SIZE + WORD_SIZE], mean)


def licenses_in(text):
    return [f.license for f in scan(text, known_sentences())[0]]


def test_notices_and_quoted_licences():
    s = SENTENCES
    assert licenses_in("Words. Licensed under the Apache License, Version 2.0. More") == ["Apache-2.0"]
    assert licenses_in("Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.") == ["MIT", "GPL-3.0"]
    assert licenses_in("SPDX-License-Identifier: BSD-3-Clause") == ["BSD-3-Clause"]
    assert licenses_in("licensed under CC BY-NC 4.0") == ["CC-BY-NC-4.0"]
    assert licenses_in("Licensed under the GNU General Public License, version 2 or later.") == ["GPL-2.0-or-later"]
    two = f"{s['bsd-grant']}: 1. {s['bsd-source']}. 2. {s['bsd-binary']}."
    assert licenses_in(two) == ["BSD-2-Clause"] and licenses_in(f"{two} 3. {s['bsd-names']}.") == ["BSD-3-Clause"]
    assert licenses_in(". ".join([s["mit-grant"], s["mit-notice"], s["mit-as-is"]])) == ["MIT"]
    assert licenses_in("No licence is named here, and nothing is licensed under terms.") == []


@pytest.mark.parametrize("before", ["", "// Copyright 2020 Some One\n//\n"])
@pytest.mark.parametrize(("license_id", "sequence"), RULES)
def test_every_rule_finds_its_header(license_id, sequence, before):
    wrapped = [re.sub(r"((?:\S+ ){6})", r"\1\n// ", SENTENCES[name]) for name in sequence]
    found, left = scan(f"{before}// " + ".\n// ".join(wrapped) + ".\n// More words here.", known_sentences())
    assert [(f.license, f.n_sentences) for f in found] == [(license_id, len(sequence))] and left == 0


@pytest.mark.parametrize("name", SENTENCES)
def test_every_sentence_is_known(name):
    found, left = scan(f"Words. {SENTENCES[name]}. Words", known_sentences())
    assert len(found) + left == 1 and all(f.sentence == 1 for f in found)


def test_headers_with_points_and_colons_inside():
    gpl = (
        "#!/bin/sh\n# Copyright (C) 2020 Some One\n#\n# This program is free software{} you can redistribute it and/or modify\n# it under the terms of the GNU General"
        " Public License as published by\n# the Free Software Foundation{} either version {} of the License, or\n# (at your option) any later version.\n#\n# This program is"
        " distributed in the hope that it will be useful,\n# but WITHOUT ANY WARRANTY; without even the implied warranty of\n# MERCHANTABILITY.\n"
    )
    known = known_sentences()
    assert scan(gpl.format(":", ",", 3), known) == ([("GPL-3.0-or-later", 0, 2)], 0)
    assert scan(gpl.format(";", ";", 2), known) == ([("GPL-2.0-or-later", 0, 2)], 0)
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one. */"
    assert scan(mpl, known) == ([("MPL-2.0", 0, 1)], 0)
    assert scan("This program is free software. It has version. 2.0. It has a warranty.", known) == ([], 0)


@pytest.mark.parametrize("verb", "licensed licenced released distributed published provided available covered governed".split())
def test_every_name_is_found_after_every_verb(verb):
    for name, license_id in NAMES.items():
        for terms in ("", "the ", "the terms of the "):
            assert licenses_in(f"Some words here. It is {verb} under {terms}{name.upper()}. More words.") == [license_id], (verb, terms, name)


def test_every_name_is_found_after_its_tag():
    assert [licenses_in(f"SPDX-License-Identifier: {name}\n") for name in NAMES] == [[v] for v in NAMES.values()]


def test_sentences_that_no_rule_uses_are_counted(spark):
    files = spark.createDataFrame([(1, SENTENCES["bsd-names"] + "."), (2, None)], "rel_path bigint, text string")
    assert {r.rel_path: (r.licenses, r.n_open) for r in scan_licenses(files).collect()} == {1: ([], 1), 2: ([], 0)}


def test_scan_of_the_given_documents_equals_a_search_for_notices(spark):
    found = {r.doc_id: r.licenses for r in QUERIES["op7_licenses"](spark, SF_DIR).collect()}
    notices = {"GNU General Public License, version 3": "GPL-3.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0"}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        assert found[r.doc_id] == ",".join(sorted(v for k, v in notices.items() if k in r.text))
