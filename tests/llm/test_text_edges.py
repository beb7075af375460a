"""Every text operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shrinkwise.llm.contamination import mark_contaminated
from shrinkwise.llm.embedding_pairs import embedding_near_duplicates
from shrinkwise.llm.exact_dedup import exact_duplicates
from shrinkwise.llm.fill_in_middle import fill_in_middle, restore_files
from shrinkwise.llm.licenses import scan_licenses
from shrinkwise.llm.main_text import extract_main_text, fit_block_labeller
from shrinkwise.llm.packing import pack_files
from shrinkwise.llm.periodic_runs import find_periodic_runs
from shrinkwise.llm.piece_codec import decode_files, encode_files, load_piece_model
from shrinkwise.llm.quality import score_quality
from shrinkwise.llm.simhash import simhash_near_duplicates
from shrinkwise.llm.substring_dedup import remove_repeated_passages
from shrinkwise.llm.toxicity import fit_toxicity, score_toxicity

LONG = " ".join(f"word{i % 997} and{i}" for i in range(40_000))
ROWS = [
    (1, "plain text of a file"), (2, None), (3, ""), (4, " \t\n "), (5, "Plain TEXT of a file"), (5, "Plain TEXT of a file"),
    (6, LONG), (7, LONG), (None, "no path"), (None, None), (8, "naïve ﬁle 漢字 🙂 \x1c\xa0 x"), (9, "a" * 50_000),
]
CLASHING = "_text _id _key _sha _row _print _class _vec _label name value pos block count score label key hash chunk ids runs root component_id".split()


def frame(spark, rows):
    files = spark.createDataFrame(rows, "rel_path bigint, text string")
    return files.select("rel_path", "text", *[F.lit("x").alias(c) for c in CLASHING])


def toxicity(files):
    labels = files.select("rel_path", F.pmod("rel_path", F.lit(2)).cast("int").alias("toxic"))
    return score_toxicity(files, fit_toxicity(files, labels))


def quality(files):
    labels = files.select("rel_path", F.pmod("rel_path", F.lit(2)).cast("int").alias("quality"))
    return score_quality(files, labels)


def codec(files):
    model = load_piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    return decode_files(encode_files(files, model), model).where("chunk = 0")


def main_text(files):
    return extract_main_text(files, fit_block_labeller(files, content="text"), content="text")


OPERATORS = {
    "simhash": simhash_near_duplicates,
    "exact": exact_duplicates,
    "packing": lambda files: pack_files(files, public_tokenizers.path("word_bpe_49k.json")).where("start = 0"),
    "substring": remove_repeated_passages,
    "toxicity": toxicity,
    "codec": codec,
    "licenses": scan_licenses,
    "main_text": main_text,
    "quality": quality,
    "contamination": lambda files: mark_contaminated(files, files, item_id="rel_path"),
    "periodic_runs": find_periodic_runs,
    "fill_in_middle": lambda files: restore_files(fill_in_middle(files)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(spark, name):
    out = OPERATORS[name](frame(spark, ROWS)).collect()
    assert sorted((r["rel_path"] for r in out), key=str) == sorted((k for k, _ in ROWS), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_gives_no_rows(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_vectors_of_an_empty_table(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert embedding_near_duplicates(none).collect() == []


def test_repeated_and_null_rows_of_exact_duplicates(spark):
    out = exact_duplicates(frame(spark, ROWS)).collect()
    plain = [r for r in out if r.keep_id == 5]
    assert sorted(r.rel_path for r in plain) == [1, 5, 5] and {r.group_size for r in plain} == {3}
    assert sum(r.kept for r in plain) == 1
    empty = [r for r in out if r.rel_path in (2, 3)]
    assert {(r.keep_id, r.group_size) for r in empty} == {(3, 3)}


def test_texts_without_words_share_the_fingerprint_zero(spark):
    out = {r.rel_path: r for r in simhash_near_duplicates(frame(spark, ROWS)).collect() if r.rel_path in (2, 3, 4)}
    assert {(r.fingerprint, r.component_id) for r in out.values()} == {("0" * 16, 2)}


def test_scores_stay_between_0_and_1(spark):
    for scored in (toxicity(frame(spark, ROWS)), quality(frame(spark, ROWS))):
        assert all(0 <= r.score <= 1 for r in scored.collect())


def test_scores_without_labels(spark):
    files = frame(spark, ROWS)
    none = spark.createDataFrame([], "rel_path bigint, toxic int, quality int")
    assert all(r.score < 0.01 for r in score_toxicity(files, fit_toxicity(files, none)).collect())
    assert {r.score for r in score_quality(files, none).collect()} == {0.0}
