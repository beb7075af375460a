"""Label catalogs: per-row lookup with fallback, and overlay of one catalog on another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.config import FALLBACK_LANGUAGE
from shrinkwise.functions.scalars import normalize_language
from shrinkwise.operators.skew import HEAVY_ROWS, spread_join


def label(
    df: DataFrame,
    key: str,
    lang: str | Column,
    labels: DataFrame,
    out: str = "label",
    large_catalog: bool = False,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Text in the row's language, else English, else the key itself.

    The catalog is folded to one row per key first, so one join serves both lookups; of several texts for one
    language and key the greatest counts. No broadcast
    is forced: Spark chooses it while the catalog's size is below its threshold, and then popular
    keys do no harm. For catalogs above it, `large_catalog` splits keys asked for very often.
    """
    single = labels.groupBy("key", "lang").agg(F.max("text").alias("text"))
    texts = single.groupBy(F.col("key").alias("_key")).agg(
        F.map_from_entries(F.collect_set(F.struct("lang", "text"))).alias("_texts")
    )
    asked = df.withColumns({"_key": F.col(key), "_lang": normalize_language(lang)})
    if large_catalog:
        joined = spread_join(asked, texts, ["_key"], df.columns, "left", heavy_rows)
    else:
        joined = asked.join(texts, "_key", "left")
    text = F.coalesce(F.col("_texts")[F.col("_lang")], F.col("_texts")[FALLBACK_LANGUAGE], F.col(key))
    return joined.withColumn(out, text).drop("_key", "_lang", "_texts")


def overlay(base: DataFrame, local: DataFrame) -> DataFrame:
    """(key, text) of both catalogs; the local text wins. One aggregation instead of an outer join."""
    both = base.select("key", F.col("text").alias("base_text"), F.lit(None).cast("string").alias("local_text")).unionByName(
        local.select("key", F.lit(None).cast("string").alias("base_text"), F.col("text").alias("local_text"))
    )
    return (
        both.groupBy("key")
        .agg(F.max("local_text").alias("local_text"), F.max("base_text").alias("base_text"))
        .select("key", F.coalesce("local_text", "base_text").alias("text"), F.col("local_text").isNotNull().alias("is_local"))
    )
