"""Inputs for the operators, derived row by row from the whole driver tables.

The formulas only rename and relabel columns; they never drop rows and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.functions.paths import file_extension
from shrinkwise.operators.routing import compressible

# Fixed values shared with the SQL restatements.
SUFFIXES = [".pdf", ".JPG", ".jpeg", ".png", ".PNG", ".txt", ".zip", ""]
MEMBER_SUFFIXES = [".jpg", ".PNG", ".txt", ".pdf"]
IMAGE_EXTS = ["jpeg", "png", "bmp", "jbig2", "gif", "JPX"]
SYMLINK_ATTR = 2717843456
REGULAR_ATTR = 2175008768
LABELS = [
    ("en", "kind.click", "Clicked"),
    ("en", "kind.view", "Viewed"),
    ("en", "kind.purchase", "Purchased"),
    ("en", "kind.error", "Failed"),
    ("ja", "kind.click", "クリック"),
    ("ja", "kind.view", "閲覧"),
]
# Message templates in English, and some of them in Japanese.
MESSAGES = [
    ("en", "worker_size_before_after", "Before: {orig} -> After: {out}{delta}"),
    ("en", "worker_size_delta_saved", " (saved: {saved}, -{saved_pct:.1f}%)"),
    ("en", "worker_size_delta_grown", " (increased: {saved}, +{saved_pct:.1f}%)"),
    ("en", "worker_size_delta_unchanged", " (no change)"),
    ("ja", "worker_size_before_after", "前 {orig} 後 {out}{delta}"),
    ("ja", "worker_size_delta_saved", "、削減 {saved} ({saved_pct:.1f}%)"),
    ("ja", "worker_size_delta_unchanged", "、変化なし"),
]
LANGUAGE_TEXTS = ["ja", "en-US", " JA_jp ", "fr", "", "EN"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(items: list[str], n: Column) -> Column:
    """items[n mod len]."""
    return F.element_at(F.array(*[F.lit(i) for i in items]), (n % len(items) + 1).cast("int"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: doc_id, rel_path, ext, size."""
    docs = read(spark, sf_dir, "documents")
    path = F.concat_ws(
        "/", "source", "lang", F.expr("n_chars div 1000"), F.concat(F.col("doc_id"), pick(SUFFIXES, F.col("doc_id")))
    )
    return docs.select(
        "doc_id",
        path.alias("rel_path"),
        file_extension(path).alias("ext"),
        F.octet_length("text").cast("bigint").alias("size"),
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome per file: orig_size, out_size, processed (every tenth attempt failed)."""
    doc, size = F.col("doc_id"), F.col("size")
    out = (
        F.when(doc % 5 == 0, size)
        .when(doc % 5 == 1, size + F.expr("size div 10"))
        .otherwise(F.expr("size * (40 + doc_id % 50) div 100"))
    )
    return manifest(spark, sf_dir).select(
        "doc_id",
        "rel_path",
        "ext",
        size.alias("orig_size"),
        out.alias("out_size"),
        (compressible("ext") & (doc % 10 != 9)).alias("processed"),
    )


MEMBER_ORDER = ["idx", "idx_part", "idx_supp"]


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as archive members; the order columns are unique within an archive."""
    line = read(spark, sf_dir, "lineitem")
    kind = F.col("l_partkey") % 97
    name = (
        F.when(kind == 0, "../x")
        .when(kind == 1, "/abs/x")
        .when(kind == 2, "C:/x")
        .when(kind == 3, "..\\x")
        .otherwise(
            F.concat(
                F.lit("dir"), "l_linenumber", F.lit("/"), "l_partkey", pick(MEMBER_SUFFIXES, F.col("l_suppkey"))
            )
        )
    )
    return line.select(
        archive_name("l_orderkey").alias("archive_path"),
        F.col("l_linenumber").alias("idx"),
        F.col("l_partkey").alias("idx_part"),
        F.col("l_suppkey").alias("idx_supp"),
        name.alias("name"),
        F.floor(F.col("l_extendedprice") * 1000).cast("bigint").alias("file_size"),
        F.when(F.col("l_suppkey") % 89 == 0, F.lit(SYMLINK_ATTR)).otherwise(F.lit(REGULAR_ATTR)).alias("external_attr"),
    )


def archive_name(key: str) -> Column:
    return F.concat(F.lit("archives/"), F.col(key).cast("string"), F.lit(".zip"))


def member_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members as files: archive_path, rel_path, ext, size."""
    return members(spark, sf_dir).select(
        "archive_path", F.col("name").alias("rel_path"), file_extension("name").alias("ext"), F.col("file_size").alias("size")
    )


def archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as archive files: archive_path, rel_path, ext, size."""
    path = archive_name("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        path.alias("archive_path"),
        path.alias("rel_path"),
        F.lit("zip").alias("ext"),
        F.floor("o_totalprice").cast("bigint").alias("size"),
    )


def estate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the input tree: documents and archives."""
    return (
        manifest(spark, sf_dir)
        .select("rel_path", "ext", "size")
        .unionByName(archives(spark, sf_dir).select("rel_path", "ext", "size"))
    )


PLACEMENT_ORDER = ["page", "seq", "slot"]


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as image placements of one document per part."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("doc_id"),
        F.col("l_linenumber").alias("page"),
        F.col("l_orderkey").alias("seq"),
        F.col("l_suppkey").alias("slot"),
        (F.col("l_suppkey") % 14 - 1).alias("xref"),
        ((F.col("l_quantity") - 1) * 10).alias("rect_w"),
        (F.col("l_quantity") * 10).alias("rect_h"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven image objects per part; object 12, which placements also name, does not exist."""
    objects = read(spark, sf_dir, "part").select(
        "p_partkey", "p_size", "p_retailprice", F.explode(F.sequence(F.lit(1), F.lit(11))).alias("i")
    )
    n = F.col("p_partkey") + F.col("i")
    palette = n % 2 == 1
    return objects.select(
        F.col("p_partkey").alias("doc_id"),
        F.col("i").cast("bigint").alias("xref"),
        pick(IMAGE_EXTS, n).alias("ext"),
        F.when(n % 11 == 0, -1).otherwise(F.col("p_size") * 100).cast("int").alias("width"),
        F.floor("p_retailprice").cast("int").alias("height"),
        (F.col("p_size") * 1000).cast("bigint").alias("size"),
        (n % 5 == 0).alias("has_alpha"),
        F.when((F.col("i") % 3 == 0) | (F.col("i") == 11), F.col("i") + 1).otherwise(0).cast("bigint").alias("smask"),
        F.when(n % 4 == 0, 255).otherwise(n % 255).cast("int").alias("min_level"),
        (F.col("p_size") * 100 * (n % 12)).cast("bigint").alias("new_size"),
        (n % 9 == 0).alias("is_cmyk"),
        F.when(palette, "palette").otherwise("pngquant").alias("quantizer"),
        F.when(palette, F.when(n % 3 == 0, "pngquant_timeout").otherwise("pngquant_unavailable")).alias("fallback_reason"),
    )


def job_events(events: DataFrame) -> DataFrame:
    """events as job events; works on batch and streaming frames."""
    kind = (
        F.when(F.col("event_type") == "click", "log")
        .when(F.col("event_type") == "view", "progress")
        .when(F.col("event_type") == "purchase", "stats")
        .when(F.col("event_type") == "signup", "status")
        .otherwise("error")
    )
    orig = F.floor(F.col("value") * 100).cast("bigint")
    out = F.floor(F.col("value") * 60).cast("bigint")
    return events.select(
        "event_id",
        F.col("user_id").alias("job_id"),
        "ts",
        kind.alias("kind"),
        F.when(F.col("event_id") % 7 != 0, F.col("props")).alias("message"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("current"),
        (F.col("event_id") + F.col("user_id")).alias("total"),
        orig.alias("orig_total"),
        out.alias("out_total"),
        (orig - out).alias("saved"),
        F.when(orig > 0, (orig - out) / orig * 100).alias("saved_pct"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files with bytes."""
    return read(spark, sf_dir, "pages").select(
        "page_id", F.col("url").alias("path"), F.col("html").cast("binary").alias("content")
    )


def label_catalog(spark: SparkSession) -> DataFrame:
    """A small two-language catalog with gaps in the second language."""
    rows = ", ".join(f"('{lang}', '{key}', '{text}')" for lang, key, text in LABELS)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS labels(lang, key, text)")


def message_catalog(spark: SparkSession) -> DataFrame:
    """Templates of result messages; the second language lacks one."""
    return spark.createDataFrame(MESSAGES, "lang string, key string, text string")
