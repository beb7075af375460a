"""Registered queries of the text operators: each maps a given table to file records and back."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.llm.common import table
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

#: Scores from here on are decided as label 1.
DECISION = 0.3


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` as files: its doc_id is the rel_path."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel_path"), "text")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(documents(spark, sf_dir)).withColumnRenamed("rel_path", "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir)).withColumnRenamed("rel_path", "doc_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("rel_path", "doc_id")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_passages(documents(spark, sf_dir)).withColumnRenamed("rel_path", "doc_id")
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def held_out(rel_path: Column, folds: int, fold: int) -> Column:
    """Rows of the fold that labels are never learned from."""
    return F.crc32(rel_path.cast("string").cast("binary")) % folds == fold


def learnable(spark: SparkSession, sf_dir: str, folds: int, fold: int) -> DataFrame:
    """Labels of the other folds."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "rel_path")
    return labels.where(~held_out(F.col("rel_path"), folds, fold))


def decided(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    out = held_out(F.col("rel_path"), folds, fold).alias("held_out")
    predicted = (F.col("score") >= DECISION).cast("int").alias("predicted")
    return scored.select(F.col("rel_path").alias("doc_id"), out, "score", predicted)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir)
    return decided(score_toxicity(files, fit_toxicity(files, learnable(spark, sf_dir, 4, 2))), 4, 2)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per chunk of a document: its ids by number and checksum, and the checksum of the text they decode to."""
    model = load_piece_model(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = encode_files(documents(spark, sf_dir), model)
    carried = encoded.select(F.struct("rel_path", F.size("ids").alias("n_ids"), F.crc32(F.to_json("ids").cast("binary")).alias("ids_crc32")).alias("rel_path"), "chunk", "start", "ids")
    texts = decode_files(carried, model)
    names = F.col("rel_path.rel_path").alias("doc_id"), "chunk", "start", "rel_path.n_ids", "rel_path.ids_crc32"
    return texts.select(*names, F.length("text").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    names = F.array_join("licenses", ",").alias("licenses")
    return found.select(F.col("rel_path").alias("doc_id"), names, F.size("findings").alias("n_findings"), "n_open")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumnRenamed("html", "content")
    labeller = fit_block_labeller(pages.withColumnRenamed("page_id", "rel_path"))
    texts = extract_main_text(pages.select(F.struct("page_id", "url").alias("rel_path"), "content"), labeller)
    return texts.select("rel_path.page_id", "rel_path.url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(score_quality(documents(spark, sf_dir), learnable(spark, sf_dir, 5, 0)), 5, 0)


def op10_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    items = F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return marked.select(F.col("rel_path").alias("doc_id"), "n_words", "n_hit", *items, "contaminated")


def repeated_tails(files: DataFrame) -> DataFrame:
    """Every tenth file by its crc32 repeats the words from some place on, with a period of a share of the rest."""
    h = F.crc32(F.col("rel_path").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    split = files.select("rel_path", "text", words.alias("words"), F.floor(h / 10).alias("g"))
    n = F.size("words")
    cut = split.withColumn("a", F.when(n > 0, F.col("g") % n))
    period = F.lit(1) + F.floor((n - F.col("a")) / (F.col("g") % 8 + 3))
    cut = cut.withColumn("p", period)
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("words", (place(i) + 1).cast("int"))), " ")
    return cut.select("rel_path", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the longest run and checksums of all runs and of the words that are left."""
    found = find_periodic_runs(repeated_tails(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    with_best = found.withColumn("best", best).withColumns({"length": F.col("best.length"), "start": -F.col("best.start"), "period": -F.col("best.period")})
    return with_best.select(
        F.col("rel_path").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), "start", "length", "period",
        F.expr("1000 * length div period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rotated = fill_in_middle(documents(spark, sf_dir))
    shown = F.struct(F.col("rel_path").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"))
    back = restore_files(rotated.select(shown.alias("rel_path"), "form", "output"))
    return back.select("rel_path.*", F.sha2("text", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_piece_codec": op6_piece_codec,
    "op7_licenses": op7_licenses,
    "op8_main_text": op8_main_text,
    "op9_quality": op9_quality,
    "op10_embedding_pairs": op10_embedding_pairs,
    "op11_decontamination": op11_decontamination,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fill_in_middle": op13_fill_in_middle,
}
