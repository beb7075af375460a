"""The audit table: one row per file handled."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.config import FALLBACK_LANGUAGE
from shrinkwise.functions.scalars import fmt1, iso_ts
from shrinkwise.operators.accounting import with_savings
from shrinkwise.operators.labels import label
from shrinkwise.sources.tables import AUDIT_SCHEMA


def audit_rows(
    results: DataFrame, finished_at: Column, action: str = "final_action", labels: DataFrame | None = None, lang: str = "en"
) -> DataFrame:
    """The ten audit columns. With a label catalog the action key is replaced by its text.

    Needs audit_input, audit_output, ext, the action column, orig_size, out_size, notes.
    """
    df = with_savings(results)
    if labels is not None:
        df = label(df, action, F.lit(lang), labels, out="_action")
    else:
        df = df.withColumn("_action", F.col(action))
    return df.select(
        iso_ts(finished_at).alias("timestamp"),
        F.col("audit_input").alias("input_path"),
        F.col("audit_output").alias("output_path"),
        "ext",
        F.col("_action").alias("action"),
        "orig_size",
        "out_size",
        "saved_bytes",
        fmt1("saved_pct").alias("saved_pct"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def default_audit_name(stamp: str) -> str:
    """`compression_log_<yyyyMMdd_HHmmss>.csv` for a stamp made with file_stamp."""
    return f"compression_log_{stamp}.csv"


def audit_headers(labels: DataFrame, lang: str) -> dict[str, str]:
    """Column titles in a language: the ten `csv_header_<column>` labels, English where missing."""
    columns = [f.name for f in AUDIT_SCHEMA.fields]
    wanted = labels.where(
        F.col("key").isin(*[f"csv_header_{c}" for c in columns]) & F.col("lang").isin(lang, FALLBACK_LANGUAGE)
    )
    found = {(r.lang, r.key.removeprefix("csv_header_")): r.text for r in wanted.collect()}
    return {c: found.get((lang, c), found.get((FALLBACK_LANGUAGE, c), c)) for c in columns}


def write_audit(
    df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", headers: Mapping[str, str] | None = None
) -> None:
    """CSV with a header in every part file, or Parquet. A folder, as any distributed writer makes.

    `headers` titles the CSV columns; reading back goes by position.
    """
    titles = headers if headers and fmt == "csv" else {}
    columns = [F.col(f.name).alias(titles.get(f.name, f.name)) for f in AUDIT_SCHEMA.fields]
    writer = df.select(columns).write.mode(mode)
    if fmt == "csv":
        writer.option("header", "true").option("encoding", "UTF-8").option("emptyValue", "").csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown audit format: {fmt}")


def audit_or_skip(
    df: DataFrame, path: str, fmt: str = "csv", headers: Mapping[str, str] | None = None
) -> str | None:
    """Write the audit but never fail the job for it; returns the error text, if any."""
    try:
        write_audit(df, path, fmt, headers=headers)
    except Exception as exc:  # noqa: BLE001 - the audit is optional by contract
        return f"{type(exc).__name__}: {exc}"
    return None

