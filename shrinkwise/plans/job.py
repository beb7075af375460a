"""One whole reduction job: scan, expand, route, transform, write, regroup, account."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.config import COMPRESSIBLE_EXTS, JobRequest, ResizeSpec
from shrinkwise.functions.paths import archive_plan, audit_paths, file_extension, paths_overlap
from shrinkwise.functions.scalars import clamp_dpi, clamp_quality, size_summary
from shrinkwise.operators.accounting import job_totals, progress
from shrinkwise.operators.archives import archive_outcomes, repack_candidates
from shrinkwise.operators.payloads import Handler, transform_payloads
from shrinkwise.operators.routing import (
    ACTION_ARCHIVE_COPY,
    build_tasks,
    compressible,
    final_action,
    not_archive,
    output_collisions,
    plan_stages,
    route,
)
from shrinkwise.session import new_shared_path, saved_table
from shrinkwise.sinks.archive_files import pack_archives
from shrinkwise.sinks.audit import audit_headers, audit_or_skip, audit_rows, default_audit_name
from shrinkwise.sinks.payload_files import write_archive_parts, write_payloads
from shrinkwise.sources.archive_files import expand_archives, expanded_verdicts
from shrinkwise.sources.scan import MAX_CONTENT, list_tree, read_contents
from shrinkwise.sources.storage import open_root
from shrinkwise.streaming.live_events import DoneLog, done_events, read_done


@dataclass(frozen=True)
class JobReport:
    """Frames describing a finished job; `totals` and `archives` have one row each."""

    results: DataFrame
    totals: DataFrame
    archives: DataFrame | None
    written: DataFrame
    audit: DataFrame
    audit_error: str | None
    events: DataFrame


class OverlappingRoots(ValueError):
    """Input and output folders contain each other."""


class CollidingOutputs(ValueError):
    """Two sources would write the same output path."""


def check_roots(spark: SparkSession, request: JobRequest) -> None:
    roots = spark.range(1).select(F.lit(request.input_dir).alias("a"), F.lit(request.output_dir).alias("b"))
    if roots.select(paths_overlap("a", "b").alias("bad")).first().bad:
        raise OverlappingRoots(f"{request.input_dir} and {request.output_dir} overlap")


def _archive_copies(archives: DataFrame) -> DataFrame:
    plan = archive_plan(archives, path="rel_path")
    return plan.select(
        F.col("rel_path").alias("audit_input"),
        F.col("rel_path").alias("audit_output"),
        F.col("archive_output_path").alias("output_path"),
        "ext",
        F.col("size").alias("orig_size"),
        F.col("path").alias("source"),
        F.concat(F.lit("zip_archive="), F.col("rel_path")).alias("notes"),
    )


def plan_tasks(spark: SparkSession, request: JobRequest, types: Iterable[str] = COMPRESSIBLE_EXTS) -> tuple[DataFrame, DataFrame | None]:
    """All tasks, and the expansion verdicts when archives are opened.

    The folder is listed once. Only files of the given types are read into rows, dealt to tasks by their bytes; all
    others, and archives that are copied, keep just the path of their `source`. Archives are opened by path: members of the
    given types are read by their offsets, all others keep their place in the archive as `source`.
    """
    listed = saved_table(list_tree(spark, request.input_dir), "manifest")
    archives, files = listed.where(~not_archive("ext")), listed.where(not_archive("ext"))
    none = archives.where(F.lit(False))
    # Repacking needs the bytes of all members; otherwise only handlers do, and the rest are copied from their archives.
    wanted_types = None if request.repack_archives else list(types)
    found_archives = (archives if request.extract else none).select(F.col("rel_path").alias("archive"), F.col("path").alias("place"))
    opened = expand_archives(found_archives, request.max_nesting, request.quota, path="archive", source="place", exts=wanted_types)
    verdicts = None
    if request.extract:
        opened = saved_table(opened, "expanded")
        verdicts = expanded_verdicts(opened)
    # A member that cannot be read stays a task: it fails with its error and gets its audit row.
    found = opened.where(F.col("kind") == "member")
    members = audit_paths(found, repack=request.repack_archives).select(
        "archive_path",
        "audit_input",
        "audit_output",
        F.col("rel_path").alias("inner_path"),
        F.col("audit_output").alias("output_path"),
        file_extension("rel_path").alias("ext"),
        F.col("file_size").alias("orig_size"),
        F.col("payload").alias("content"),
        "source",
        "notes",
        F.col("error").alias("read_error"),
    )
    copied = request.mirror and not request.repack_archives
    wanted = F.col("ext").isin(*types) & (F.col("size") <= MAX_CONTENT)
    read = read_contents(files.where(wanted)).unionByName(files.where(~wanted), allowMissingColumns=True)
    plain = read.select(
        *[F.col("rel_path").alias(c) for c in ("audit_input", "audit_output", "output_path")],
        "ext",
        F.col("size").alias("orig_size"),
        "content",
        F.col("path").alias("source"),
        F.lit("").alias("notes"),
    )
    return build_tasks(plain, members.where(not_archive("ext")), _archive_copies(archives if copied else none)), verdicts


def planned_settings(tasks: DataFrame, request: JobRequest) -> DataFrame:
    """Adds `settings`, what a handler needs to know besides the bytes: quality and resolution within their limits,
    the stages of a PDF, and how to resize. Planned as columns, so that it can be looked at before a job runs."""
    quality = clamp_quality(F.when(F.col("ext") == "png", request.png_quality).otherwise(request.jpeg_quality), 75, is_text=False)
    engine = {"_engine": F.lit(request.pdf_engine), "_mode": F.lit(request.pdf_mode), "_lossless": F.lit(request.pdf_lossless)}
    staged = plan_stages(tasks.withColumns(engine), "_engine", "_mode", "_lossless").drop(*engine)
    resize = request.resize or ResizeSpec()
    wanted = F.struct(
        quality.alias("quality"),
        clamp_dpi(F.lit(request.target_dpi)).alias("target_dpi"),
        F.when(F.col("ext") == "pdf", F.col("stages")).alias("stages"),
        F.when(
            F.lit(request.resize is not None),
            F.struct(*[F.lit(getattr(resize, c)).alias(c) for c in ("mode", "long_edge", "width", "height", "keep_aspect", "allow_upscale")]),
        ).alias("resize"),
    )
    return staged.withColumn("settings", wanted).drop("stages")


def run_job(
    spark: SparkSession,
    request: JobRequest,
    handlers: Mapping[str, Handler],
    labels: DataFrame | None = None,
    started_at: datetime | None = None,
    job_id: str = "job",
    events_folder: str | None = None,
) -> JobReport:
    """Run the job and return what happened. `handlers` maps an extension to bytes -> bytes, or to
    bytes and planned_settings -> bytes.

    A file whose handler fails keeps ok = false; mirroring then copies the original. An archive member that cannot
    be read also has ok = false and its error, and nothing is copied. Files the job has no handler for count
    as not processed. Tasks log what they have done into `events_folder`, by default one in the shared folder, where watch_done
    sees it while the job runs; `events` are those of the attempts that counted, with texts in the request's language if
    there are labels. Audit rows carry the time when their file was done. Results are written to the shared folder once, and
    outputs, archives, audit and totals are all read from there.
    """
    check_roots(spark, request)
    started_at = started_at or datetime.now()
    tasks, verdicts = plan_tasks(spark, request, [t for t in handlers if t in COMPRESSIBLE_EXTS])
    clash = output_collisions(tasks.select("output_path", F.col("audit_input").alias("source_path"))).first()
    if clash is not None:
        raise CollidingOutputs(f"{clash.output_path} would be written by {clash.writers} sources")

    events_folder = events_folder or new_shared_path(spark, "events")
    # Tasks log nothing for a job without files; its folder is read all the same.
    where, logged = open_root(events_folder)
    where.create_dir(logged, recursive=True)
    copy = F.col("origin") == "archive_copy"
    work = route(tasks).withColumn("key", F.when(~copy & compressible("ext"), F.col("ext")))
    done = transform_payloads(planned_settings(work, request), handlers, key="key", keep_original=True, settings="settings", on_done=DoneLog(events_folder, job_id))
    unread = F.col("read_error").isNotNull()
    done = done.withColumns(
        {
            "ok": F.when(unread, False).otherwise(F.col("ok")),
            "error": F.coalesce("read_error", "error"),
            "processed": F.coalesce("ok", F.lit(False)),
            "source": F.when(~unread, F.col("source")),
        }
    )
    done = final_action(done, F.lit(request.mirror) & ~unread).withColumns(
        {
            "final_action": F.when(copy, F.lit(ACTION_ARCHIVE_COPY)).otherwise(F.col("final_action")),
            "out_size": F.coalesce("out_size", "orig_size"),
            "written_content": F.when(F.col("processed") | F.lit(request.mirror), F.col("out_content")),
        }
    )
    results = saved_table(done.drop("out_content", "key", "read_error"), "results")

    # What has no bytes in its row is copied from its source: files nobody handles, and archives.
    from_source = F.lit(request.mirror) & F.col("source").isNotNull()
    outputs = results.where(F.col("written_content").isNotNull() | from_source)
    in_archive = (F.col("origin") == "member") & F.lit(request.repack_archives)
    written = write_payloads(outputs.where(~in_archive), request.output_dir, "output_path", "written_content", "source")
    if request.repack_archives:
        packed_files = outputs.where(in_archive)
        paths = archive_plan(packed_files).select(
            F.col("archive_output_path").alias("archive_path"), "inner_path", "written_content"
        )
        parts = pack_archives(paths, name="inner_path", content="written_content")
        written = written.unionByName(write_archive_parts(parts, request.output_dir))
    written = saved_table(written, "written")

    audit = audit_rows(results, F.col("finished_at"), labels=labels, lang=request.language)
    audit_error = None
    if request.audit:
        name = default_audit_name(started_at.strftime("%Y%m%d_%H%M%S"))
        headers = audit_headers(labels, request.language) if labels is not None else None
        audit_error = audit_or_skip(audit, request.audit_path or f"{request.output_dir}/{name}", headers=headers)
    archives = archive_outcomes(verdicts) if verdicts is not None else None
    return JobReport(
        results=results.drop("written_content"),
        totals=job_totals(results),
        archives=archives,
        written=written,
        audit=audit,
        audit_error=audit_error,
        events=done_events(read_done(spark, events_folder, results), labels, request.language),
    )


def job_events(results: DataFrame, job_id: str) -> DataFrame:
    """The events of a finished job, as dispatch_events and job_state read them: for every file a progress event, and
    a log or error event with its text; then the job's totals and its last status."""
    text = F.concat(F.col("audit_input"), F.lit(": "), F.coalesce(F.col("error"), size_summary("orig_size", "out_size")))
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    done = progress(results.withColumn("job_id", F.lit(job_id)), task="audit_input")
    per_file = done.select(
        "job_id", F.col("finished_at").alias("ts"), F.concat(F.lit("1 "), "audit_input").alias("event_id"),
        F.explode(F.array(F.lit("progress"), F.when(failed, "error").otherwise("log"))).alias("kind"),
        text.alias("message"), "current", "total",
    )
    per_file = per_file.withColumn("message", F.when(F.col("kind") != "progress", F.col("message")))
    last = results.agg(F.max("finished_at").alias("ts")).crossJoin(job_totals(results))
    ends = last.select(
        F.lit(job_id).alias("job_id"), "ts", F.lit("2").alias("event_id"), F.explode(F.array(F.lit("stats"), F.lit("status"))).alias("kind"),
        "orig_total", "out_total", "saved", "saved_pct",
    )
    ends = ends.withColumn("message", F.when(F.col("kind") == "status", F.lit("status_complete")))
    return per_file.unionByName(ends, allowMissingColumns=True)


def archives_to_repack(results: DataFrame) -> DataFrame:
    """Archives of a finished job that have at least one output of their own."""
    members = results.where(F.col("origin") == "member")
    return repack_candidates(members.select("archive_path").distinct(), members.where("processed"))
