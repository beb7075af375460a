"""Which handler a file gets, how its audit row is labelled, and which outputs a job will produce."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shrinkwise.config import ARCHIVE_EXT, COMPRESSIBLE_EXTS, JPEG_EXTS
from shrinkwise.functions.paths import archive_plan, audit_paths

# Audit action keys (label catalog keys).
ACTION_PDF = "csv_action_pdf"
ACTION_JPEG = "csv_action_jpeg"
ACTION_PNG = "csv_action_png"
ACTION_FAILED = "csv_action_failed"
ACTION_NON_TARGET = "csv_action_non_target_copy"
ACTION_FALLBACK = "csv_action_fallback_copy"
ACTION_ARCHIVE_COPY = "csv_action_zip_copy"

PDF_MODES = ("lossy", "lossless", "both")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def not_archive(ext: Column | str = "ext") -> Column:
    return F.lower(_col(ext)) != ARCHIVE_EXT


def compressible(ext: Column | str = "ext") -> Column:
    return _col(ext).isin(*COMPRESSIBLE_EXTS)


def in_extensions(ext: Column | str, exts: Iterable[str]) -> Column:
    wanted = [e.lower().lstrip(".") for e in exts]
    return F.lower(_col(ext)).isin(*wanted) if wanted else F.lit(False)


def with_extensions(df: DataFrame, exts: Iterable[str], ext: str = "ext") -> DataFrame:
    """Files of the given types; an empty set selects nothing."""
    return df.where(in_extensions(ext, exts))


def cleanup_targets(df: DataFrame, exts: Iterable[str] = (), ext: str = "ext") -> DataFrame:
    """Files a cleanup removes; here an empty set means every file."""
    exts = list(exts)
    return df.where(in_extensions(ext, exts)) if exts else df


def route(df: DataFrame, ext: str = "ext") -> DataFrame:
    """Add `handler` and the audit `action_key` of a successful run."""
    e = F.col(ext)
    pdf, jpeg, png = e == "pdf", e.isin(*JPEG_EXTS), e == "png"
    return df.withColumns(
        {
            "handler": F.when(pdf, "pdf").when(jpeg, "jpeg").when(png, "png").otherwise("none"),
            "action_key": F.when(pdf, ACTION_PDF).when(jpeg, ACTION_JPEG).when(png, ACTION_PNG).otherwise(ACTION_FAILED),
        }
    )


def final_action(df: DataFrame, mirror: bool | Column, processed: str = "processed", ext: str = "ext") -> DataFrame:
    """Replace the action of files that were not processed: copied when mirroring, else failed."""
    mirror = F.lit(mirror) if isinstance(mirror, bool) else mirror
    return df.withColumn(
        "final_action",
        F.when(F.col(processed), F.col("action_key"))
        .when(mirror & ~compressible(ext), ACTION_NON_TARGET)
        .when(mirror, ACTION_FALLBACK)
        .otherwise(ACTION_FAILED),
    )


def plan_stages(
    df: DataFrame, engine: str = "engine", mode: str = "mode", use_lossless: str = "use_lossless"
) -> DataFrame:
    """Ordered PDF stages; unknown modes run both, the distiller adds lossless only on request."""
    m = F.when(F.col(mode).isin(*PDF_MODES), F.col(mode)).otherwise("both")
    gs = F.when(F.col(use_lossless), F.array(F.lit("gs"), F.lit("lossless"))).otherwise(F.array(F.lit("gs")))
    native = F.when(m == "both", F.array(F.lit("lossy"), F.lit("lossless"))).otherwise(F.array(m))
    return df.withColumn("stages", F.when(F.col(engine) == "gs", gs).otherwise(native))


def resolve_stages(df: DataFrame) -> DataFrame:
    """What is kept after the stages ran.

    Reads `stages`, `orig_size` and the stage reports `lossy_ok, lossy_size, lossless_ok,
    lossless_size, gs_skipped, gs_size`; adds `outcome`, `ok`, `out_size`.
    """
    two_stages = F.size("stages") == 2
    distilled = F.array_contains("stages", "gs")
    native_both = ~distilled & two_stages
    lossy_ok = F.coalesce(F.col("lossy_ok"), F.lit(False))
    lossless_ok = F.coalesce(F.col("lossless_ok"), F.lit(False))
    skipped = F.coalesce(F.col("gs_skipped"), F.lit(False))
    no_gain = F.col("gs_size") >= F.col("orig_size")
    outcome = (
        F.when(native_both & lossy_ok & lossless_ok, "lossy+lossless")
        .when(native_both & lossy_ok, "lossy_kept")
        .when(native_both & lossless_ok, "lossless_on_original")
        .when(native_both, "failed")
        .when(distilled & skipped, "original_kept")
        .when(distilled & two_stages & lossless_ok, F.when(no_gain, "original+lossless").otherwise("gs+lossless"))
        .when(distilled & two_stages, F.when(no_gain, "original_kept").otherwise("gs_kept"))
        .when(distilled, F.when(no_gain, "original_kept").otherwise("gs"))
        .when(F.array_contains("stages", "lossy"), F.when(lossy_ok, "lossy").otherwise("failed"))
        .otherwise(F.when(lossless_ok, "lossless").otherwise("failed"))
    )
    done = df.withColumn("outcome", outcome)
    o = F.col("outcome")
    size = (
        F.when(o.isin("lossy+lossless", "lossless_on_original", "original+lossless", "gs+lossless", "lossless"), F.col("lossless_size"))
        .when(o.isin("lossy_kept", "lossy"), F.col("lossy_size"))
        .when(o.isin("gs_kept", "gs"), F.col("gs_size"))
    )
    return done.withColumns({"ok": o != "failed", "out_size": F.coalesce(size, F.col("orig_size"))})


def keep_smaller(df: DataFrame, orig: str = "orig_size", new: str = "new_size") -> DataFrame:
    """Accept the new version only when strictly smaller; adds `accepted` and `kept_size`."""
    accepted = F.coalesce(F.col(new) < F.col(orig), F.lit(False))
    return df.withColumns(
        {"accepted": accepted, "kept_size": F.when(accepted, F.col(new)).otherwise(F.col(orig))}
    )


def build_tasks(files: DataFrame, members: DataFrame, copies: DataFrame) -> DataFrame:
    """UNION ALL of plain files, archive members and archive copies; `origin` tells them apart."""
    return (
        files.withColumn("origin", F.lit("file"))
        .unionByName(members.withColumn("origin", F.lit("member")), allowMissingColumns=True)
        .unionByName(copies.withColumn("origin", F.lit("archive_copy")), allowMissingColumns=True)
    )


def plan_outputs(
    manifest: DataFrame, members: DataFrame, extract: bool, mirror: bool, repack: bool
) -> DataFrame:
    """Every path the job will write: (output_path, origin, source_path).

    `manifest` needs rel_path and ext, `members` (already judged safe) archive_path, rel_path, ext.
    """
    return plan_outputs_each(manifest, members, [(extract, mirror, repack)]).drop("written_by")


def plan_outputs_each(manifest: DataFrame, members: DataFrame, settings: Sequence[tuple[bool, bool, bool]]) -> DataFrame:
    """plan_outputs under several (extract, mirror, repack), at most 63, with each path made once.

    Bit i of `written_by` is set where settings[i] writes the path.
    """

    def bits(chosen: Sequence[bool]) -> int:
        return sum(1 << i for i, wanted in enumerate(chosen) if wanted)

    def written(chosen: Sequence[bool], target: Column) -> Column:
        """Of the chosen settings, those that mirror; for a target all of them."""
        mirrored = [wanted and mirror for wanted, (_, mirror, _) in zip(chosen, settings, strict=True)]
        return F.when(target, F.lit(bits(chosen))).otherwise(F.lit(bits(mirrored))).cast("bigint").alias("written_by")

    packed = [extract and repack for extract, _, repack in settings]
    plain = [extract and not repack for extract, _, repack in settings]
    copied = [mirror and not inside for (_, mirror, _), inside in zip(settings, packed, strict=True)]
    plan = manifest.where(not_archive()).select(
        F.col("rel_path").alias("output_path"),
        F.lit("file").alias("origin"),
        F.col("rel_path").alias("source_path"),
        written([True] * len(settings), compressible()),
    )
    if any(copied):
        copies = archive_plan(manifest.where(~not_archive()), path="rel_path")
        plan = plan.unionByName(
            copies.select(
                F.col("archive_output_path").alias("output_path"),
                F.lit("archive_copy").alias("origin"),
                F.col("rel_path").alias("source_path"),
                F.lit(bits(copied)).cast("bigint").alias("written_by"),
            )
        )
    kept = members.where(not_archive())
    if any(packed):
        archives = archive_plan(kept.groupBy("archive_path").agg(F.max(compressible()).alias("_target")))
        plan = plan.unionByName(
            archives.select(
                F.col("archive_output_path").alias("output_path"),
                F.lit("repacked_archive").alias("origin"),
                F.col("archive_path").alias("source_path"),
                written(packed, F.col("_target")),
            )
        )
    if any(plain):
        plan = plan.unionByName(
            audit_paths(kept).select(
                F.col("audit_output").alias("output_path"),
                F.lit("member").alias("origin"),
                F.col("audit_input").alias("source_path"),
                written(plain, compressible()),
            )
        )
    return plan.where("written_by != 0")


def output_collisions(plan: DataFrame) -> DataFrame:
    """Output paths more than one source would write to."""
    return (
        plan.groupBy("output_path")
        .agg(F.count(F.lit(1)).alias("writers"), F.min("source_path").alias("first_source"))
        .where(F.col("writers") > 1)
    )
