"""Fill-in-middle forms, benchmark items and periodic runs of file records, against brute force and SQL."""

import hashlib
import random
import re

import pytest
from conftest import write_tree
from oracle_compare import compare, connect
from pyspark.sql import functions as F

from shrinkwise.llm import contamination, fill_in_middle as fim
from shrinkwise.llm.contamination import mark_contaminated
from shrinkwise.llm.file_texts import decode, decode_files
from shrinkwise.llm.fill_in_middle import draws, fill_in_middle, rearranged, restore_files, restored, rotate
from shrinkwise.llm.oracle import ORACLE
from shrinkwise.llm.periodic_runs import find_periodic_runs, periodic_runs, runs_of_all
from shrinkwise.llm.queries import QUERIES, documents, repeated_tails
from shrinkwise.sources.scan import scan_files

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op4_substring_dedup", "op10_embedding_pairs", "op11_decontamination", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, name):
    con = connect(SF_DIR)
    assert compare(QUERIES[name](spark, SF_DIR), con, ORACLE[name]) == []
    con.close()


# Contents of files


def test_charsets_are_told_by_marks_and_validity():
    assert decode("naïve 漢".encode()) == ("naïve 漢", "utf-8", None)
    assert decode(b"\xef\xbb\xbfx") == ("x", "utf-8", None)
    for charset in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        assert decode("\ufeffnaïve 🙂".encode(charset)) == ("naïve 🙂", charset, None)
    assert decode(b"caf\xe9 \x80") == ("café €", "cp1252", None)
    assert decode(b"\x81\xe9") == ("\x81é", "latin-1", None)
    assert decode(b"\xff\xfea\x00b") == ("a�", "utf-16-le", "truncated data at byte 4")
    assert decode(b"") == ("", "utf-8", None)


def test_operators_run_on_scanned_files(spark, tmp_path):
    question = "which of these eleven words stands at the very end here"
    files = {
        "a/quiz.txt": f"Before it. {question.upper()}? After it.\nMore.\n".encode(),
        "a/wide.txt": ("\ufeff" + "line one\nline two\n" * 3).encode("utf-16-le"),
        "loop.md": b"start " + b"one two three " * 5 + b"end",
        "_hidden": b"caf\xe9",
        "empty.txt": b"",
    }
    write_tree(tmp_path, files)
    texts = decode_files(scan_files(spark, str(tmp_path), with_content=True))
    assert {r.rel_path: (r.charset, r.size) for r in texts.collect()} == {
        p: ({"a/wide.txt": "utf-16-le", "_hidden": "cp1252"}.get(p, "utf-8"), len(d)) for p, d in files.items()
    }
    items = spark.createDataFrame([("q1", question)], "item_id string, text string")
    marked = {r.rel_path: r for r in mark_contaminated(texts, items).collect()}
    quiz = marked["a/quiz.txt"]
    assert (quiz.n_hit, quiz.items, quiz.n_words) == (11, ["q1"], 16)
    assert [files["a/quiz.txt"].decode()[s.start : s.stop] for s in quiz.spans] == [question.upper()]
    assert {p for p, r in marked.items() if r.contaminated} == {"a/quiz.txt"} and len(marked) == len(files)
    runs = {r.rel_path: r for r in find_periodic_runs(texts).collect()}
    assert [tuple(x) for x in runs["loop.md"].runs] == [(1, 15, 3)] and runs["loop.md"].collapsed == "start one two three end"
    assert [tuple(x) for x in runs["a/wide.txt"].runs] == [(0, 12, 4)]
    rotated = fill_in_middle(texts)
    back = {r.rel_path: r.text for r in restore_files(rotated).collect()}
    assert back == {r.rel_path: r.text for r in texts.collect()}
    assert {r.rel_path: (r.n, r.form) for r in rotated.collect()}["empty.txt"] == (0, "plain")


def test_files_without_content_have_no_text(spark):
    files = spark.createDataFrame([("a", None, "old")], "rel_path string, content binary, text string")
    assert [tuple(r) for r in decode_files(files).collect()] == [("a", None, None, None)]
    assert decode_files(files.limit(0)).collect() == []


# Fill-in-middle


def plain_form(text, key, seed=7):
    """The form by slices of a list of lines."""
    h = [int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    parts = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    order = {"spm": "<S>{2}<P>{0}<M>{1}", "psm": "<P>{0}<S>{2}<M>{1}"}[form]
    return len(lines), form, len(parts[0]), len(parts[1]), order.replace("{0}", parts[0]).replace("{1}", parts[1]).replace("{2}", parts[2])


def test_forms_equal_slices_and_come_back_exactly(monkeypatch):
    rng = random.Random(3)
    for exchanged in (1, 3, 1 << 16):
        monkeypatch.setattr(fim, "EXCHANGED", exchanged)
        for key in range(400):
            text = "".join(rng.choices(["a", "é", "漢🙂", "\n", "\n", "<", "<P", "S>", ">", "\r", "M"], k=rng.randint(0, 40)))
            n, form, prefix, middle, output = rearranged(text.encode(), draws(7, str(key)), 100, 50)
            assert (n, form, prefix, middle, output.decode()) == plain_form(text, key)
            assert restored(output, form).decode() == text


def test_rotation_exchanges_blocks_in_place():
    import numpy as np

    for first, middle, last in ((0, 3, 9), (2, 2, 5), (1, 6, 6), (0, 1, 10), (4, 7, 8)):
        view = np.arange(10, dtype=np.uint8)
        rotate(view, first, middle, last)
        old = list(range(10))
        assert view.tolist() == old[:first] + old[middle:last] + old[first:middle] + old[last:]


def test_shares_of_forms_follow_the_percentages(spark):
    files = spark.range(400).select(F.col("id").alias("rel_path"), F.lit("one\ntwo\nthree").alias("text"))
    forms = {(f, s): {r.form: r["count"] for r in fill_in_middle(files, fim_percent=f, spm_percent=s).groupBy("form").count().collect()} for f, s in ((0, 50), (100, 0), (100, 100), (50, 50))}
    assert forms[0, 50] == {"plain": 400} and forms[100, 0] == {"psm": 400} and forms[100, 100] == {"spm": 400}
    assert 150 < forms[50, 50]["plain"] < 250 and forms[50, 50].keys() == {"plain", "psm", "spm"}


def test_an_output_without_its_sentinels_is_an_error(spark):
    broken = spark.createDataFrame([(1, "psm", "<P>a<M>b")], "rel_path int, form string, output string")
    with pytest.raises(Exception, match="subsection not found"):
        restore_files(broken).collect()


# Benchmark items


def plain_hits(text, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    own, hit, named = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i : i + window]
            for at in range(len(own) - len(part) + 1):
                if own[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    named |= {str(item)} - {"None"}
    return len(own), len(hit), sorted(named)


def test_hits_equal_a_search_for_every_window(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "B", "b", "É", "é", "x1", "漢", "word", "Word"]
    phrase = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "\x7f", "_"]) for w in rng.choices(vocabulary, k=n))
    items = [(i % 11 if i else None, phrase(rng.randint(0, 16))) for i in range(24)] + [(50, None), (51, ""), (52, "word")]
    texts = [(i, "".join(phrase(rng.randint(0, 6)) + (rng.choice(items)[1] or "") for _ in range(4))) for i in range(60)]
    texts += [(60, None), (60, ""), (None, "word"), (61, " \x00 ")]
    files = spark.createDataFrame(texts, "rel_path int, text string").withColumn("items", F.lit("x"))
    known = spark.createDataFrame(items, "item_id int, text string")
    expected = sorted((str(k), *plain_hits(t, items)) for k, t in texts)
    for windows in (contamination.AUTOMATON_WINDOWS, 40):
        rows = mark_contaminated(files, known, automaton_windows=windows).collect()
        assert sorted((str(r.rel_path), r.n_words, r.n_hit, r["items"]) for r in rows) == expected
        assert all(r.contaminated == (r.n_hit > 0) for r in rows)
    by_id = dict(texts)
    for r in rows:
        inside = [by_id[r.rel_path][s.start : s.stop] for s in r.spans if r.rel_path != 60]
        assert r.rel_path == 60 or sum(len(contamination.words_of(t.encode())) for t in inside) == r.n_hit


def test_nothing_is_hit_without_items(spark):
    files = spark.createDataFrame([(1, "some words")], "rel_path int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [(r.n_words, r.n_hit, r["items"], r.spans) for r in mark_contaminated(files, none).collect()] == [(2, 0, [], [])]
    assert mark_contaminated(files.limit(0), none).collect() == []


# Periodic runs


def plain_runs(words, least):
    """Runs by comparing all words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length, run = j - i + q, words[i : j + q]
            if j > i and length >= max(least, 2 * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def sequences(rng, n):
    for _ in range(n):
        words = rng.choices(range(rng.choice([1, 2, 2, 3, 30])), k=rng.randint(0, 70))
        if words and rng.random() < 0.5:
            at, period = rng.randrange(len(words)), rng.randint(1, 20)
            words = [words[at + (i - at) % period] if i >= at else w for i, w in enumerate(words)]
        yield words


@pytest.mark.parametrize("least", [1, 5, 12, 13])
def test_runs_equal_a_comparison_of_all_words(least):
    rng = random.Random(least)
    for words in sequences(rng, 500):
        assert sorted(periodic_runs(words, least)) == plain_runs(words, least)
    many = [[f"w{k}".encode() for k in w] for w in sequences(rng, 200)]
    assert runs_of_all(many, least) == [plain_runs(w, least) for w in many]


def test_a_long_text_of_one_word_is_one_run():
    assert periodic_runs([0] * 200_000) == [(0, 200_000, 1)]


def test_runs_of_the_given_documents_equal_brute_force(spark):
    texts = {r.rel_path: r.text for r in repeated_tails(documents(spark, SF_DIR)).collect()}
    originals = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op12_periodic_runs"](spark, SF_DIR).collect()
    assert len(rows) == len(originals)
    import zlib

    for r in rows:
        words, h = WORD.findall(originals[r.doc_id] or ""), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        assert words == WORD.findall(texts[r.doc_id] or "")
        if len(words) > 1500:
            continue
        runs = plain_runs(words, 12)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        left = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert r.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
