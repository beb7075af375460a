"""Learned scores on held-out labels, and the matching behind them."""

import random

import pytest
from pyspark.sql import functions as F

from shrinkwise.llm import quality
from shrinkwise.llm.learning import labelled_sample
from shrinkwise.llm.queries import QUERIES
from shrinkwise.llm.toxicity import QUOTED_WEIGHT, Matcher, accepts, context_weight, learn_lexicon, start, step

SF_DIR = "/root/testdata/sf0.1"


def area_under_curve(rows):
    """Share of pairs of labels 1 and 0 that the scores put in order."""
    good, bad = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.parametrize(("query", "label", "least"), [("op5_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.95)])
def test_held_out_labels_are_told_apart(spark, query, label, least):
    scored = QUERIES[query](spark, SF_DIR)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("score", F.col(label)).collect()
    assert area_under_curve([tuple(r) for r in rows]) >= least
    assert scored.where("predicted != cast(score >= 0.3 as int)").count() == 0


def test_a_sample_is_bounded_where_files_and_labels_repeat(spark):
    files = spark.range(3000).select((F.col("id") % 3).alias("rel_path"), F.concat_ws(" ", F.lit("text"), "id").alias("text"))
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 0), (None, 1), (2, 7)], "rel_path bigint, toxic int")
    sample = labelled_sample(files, labels, "rel_path", "text", "toxic", 100)
    assert {r.label: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 100, 1: 100}


def test_forms_of_junk_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "FORMS", 50)
    junk = "".join(chr(0x2200 + k) for k in range(40))
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices(junk, k=6)) for _ in range(50)) + " plain Words 12" for _ in range(40)]
    vectors = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert len(vectors) == 50 + 3 and {"~a", "~0", "plain", "Words", "12"} <= vectors.keys()


def test_the_automaton_accepts_one_change():
    def read(word, term):
        state = start(word)
        for letter in term:
            state = step(word, state, letter)
        return bool(accepts(word, state))

    for word in ("idiot", "idio", "idiott", "idxot", "xdiot", "diot", "idit"):
        assert read(word, "idiot"), word
    for word in ("idixx", "iiddot", "id", "idioooot", ""):
        assert not read(word, "idiot"), word


def test_words_match_exactly_by_beginning_by_signs_and_misspelled():
    matcher = Matcher({"idiot": 8.0, "scum": 6.0, "réeux*": 4.0})
    assert [matcher.weight(w) for w in ("Idiot!", "scum,", "réeuxan", "plain", "scumm", "réeu")] == [8.0, 6.0, 4.0, 0.0, 0.0, 0.0]
    assert [matcher.weight(w) > 0 for w in ("idiott", "1d1ot", "idi0t", "idot", "patriot")] == [True, True, True, True, False]


def learned(spark, toxic_words, clean_words=("kind",)):
    """Lexicon of files with one of the words each among plain ones."""
    rows = [(f"some plain words here {w} and more", y) for y, words in ((1, toxic_words), (0, clean_words)) for w in words for _ in range(60)]
    return learn_lexicon(spark.createDataFrame(rows, "text string, label int"))


def test_a_whole_word_drops_no_longer_or_shorter_term(spark):
    # Clean words with the same beginnings keep those from being chosen.
    lexicon = learned(spark, ["ass", "ass", "asshole", "asshole", "asshole", "scum"], ["assume", "assign", "asshort", "assholder"])
    matcher = Matcher(lexicon)
    assert {"ass", "asshole"} <= lexicon.keys() and "ass*" not in lexicon
    assert [matcher.exact(w) > 0 for w in ("ass", "asshole", "assume", "assign")] == [True, True, False, False]


def test_misspellings_match_behind_a_learned_beginning(spark):
    lexicon = learned(spark, ["idiot", "idiot", "idiots", "scum"])
    matcher = Matcher(lexicon)
    assert any(c.endswith("*") and "idiots".startswith(c[:-1]) for c in lexicon)
    assert [matcher.weight(w) > 0 for w in ("idiot", "idiots", "idxot", "ideot", "idots", "ideots", "ixxots")] == [True] * 6 + [False]
    assert matcher.weight("idiots") == matcher.weight("idiot") > matcher.weight("idxot")


def test_quoted_words_weigh_less_than_used_ones():
    words = 'he wrote "you are an idiot" on paper and left'.split()
    assert context_weight(words, 5) == QUOTED_WEIGHT
    assert context_weight("what an idiot they are".split(), 2) == 1.0
    assert context_weight("you are an idiot".split(), 3) > 1.0
