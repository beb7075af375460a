"""The text of a file's result in a user's language, composed from the label catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.config import FALLBACK_LANGUAGE, LANGUAGES
from shrinkwise.functions.scalars import fill_template, human_readable, normalize_language, saved_bytes, saved_pct

# Keys of the catalog's templates for sizes before and after, and for their difference.
SIZES, SAVED, GROWN, UNCHANGED = "worker_size_before_after", "worker_size_delta_saved", "worker_size_delta_grown", "worker_size_delta_unchanged"
SIZE_KEYS = (SIZES, SAVED, GROWN, UNCHANGED)


def language_texts(labels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(_lang, _texts): for each language the texts of some keys, English where it has none; at most a row per language."""
    single = labels.where(F.col("key").isin(*keys)).groupBy("key", "lang").agg(F.max("text").alias("text"))
    by_key = single.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("lang", "text"))).alias("by_lang"))
    each = by_key.select("key", "by_lang", F.explode(F.array(*[F.lit(c) for c in LANGUAGES])).alias("_lang"))
    text = F.coalesce(F.col("by_lang")[F.col("_lang")], F.col("by_lang")[FALLBACK_LANGUAGE])
    known = each.select("_lang", "key", text.alias("text")).where(F.col("text").isNotNull())
    return known.groupBy("_lang").agg(F.map_from_entries(F.collect_list(F.struct("key", "text"))).alias("_texts"))


def result_messages(
    results: DataFrame, labels: DataFrame, lang: str | Column, base: Column | str | None = None, orig: str = "orig_size", out: str = "out_size",
    growth_as_signed: bool = False,
) -> DataFrame:
    """Adds `message`: sizes before and after and what was saved, in the language of each row.

    Templates come from the catalog by their keys; a language that lacks one uses English, and a key that no
    language has shows itself, as in every lookup. The catalog is folded to one row per language, so the results are joined once by
    language. With `base`, its text goes before, parted by a bar. Without an output size the message is `base` alone.
    """
    texts = language_texts(labels, SIZE_KEYS)
    asked = results.withColumn("_lang", normalize_language(lang if isinstance(lang, Column) else F.lit(lang)))
    joined = asked.join(texts, "_lang", "left")
    text = {key: F.coalesce(F.col("_texts")[key], F.lit(key)) for key in SIZE_KEYS}
    saved, pct = saved_bytes(orig, out), saved_pct(orig, out)
    template = F.when(saved > 0, text[SAVED]).when(saved < 0, text[GROWN]).otherwise(text[UNCHANGED])
    shown_pct = F.when(saved < 0, pct if growth_as_signed else F.abs(pct)).otherwise(pct)
    # Templates first become columns, so that each is filled once.
    ready = joined.withColumns({"_delta": template, "_sizes": text[SIZES]})
    ready = ready.withColumn("_delta", fill_template("_delta", saved=human_readable(F.abs(saved)), saved_pct=shown_pct))
    sizes = fill_template("_sizes", orig=human_readable(orig), out=human_readable(out), delta=F.col("_delta"))
    message = F.when(F.col(out).isNotNull(), sizes)
    if base is not None:
        message = F.concat_ws(" | ", F.col(base) if isinstance(base, str) else base, message)
    return ready.withColumn("message", message).drop("_lang", "_texts", "_delta", "_sizes")
