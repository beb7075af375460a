"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import itertools
import time
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.config import INPUT_CLEANUP_EXTS, OUTPUT_CLEANUP_EXTS, Quota, ResizeSpec
from shrinkwise.functions import paths, scalars
from shrinkwise.operators import accounting, archives, cleanup, imageplan, labels, messages, payloads, routing
from shrinkwise.operators.folder_digests import tree_diff_by_folders
from shrinkwise.operators.roots import containing_roots
from shrinkwise.plans import adapters as src
from shrinkwise.session import new_shared_path, saved_table
from shrinkwise.sinks.archive_files import pack_archives
from shrinkwise.sinks.audit import audit_rows as audit_table
from shrinkwise.sinks.audit import write_audit
from shrinkwise.sinks.committed_files import write_committed
from shrinkwise.sinks.payload_files import write_payloads
from shrinkwise.sources.archive_files import expand_archives, expanded_members, expanded_verdicts, list_members, unreadable_members
from shrinkwise.sources.folder_source import FOLDER_FORMAT, INTAKE_FORMAT, register_folder_sources
from shrinkwise.sources.scan import list_tree, read_audit, read_contents, read_labels, scan_archives, scan_files, scan_images
from shrinkwise.streaming import monitor
from shrinkwise.streaming.live_events import DoneLog, done_events, read_done
from shrinkwise.streaming.seen_paths import SETTINGS, admit_paths

# Limits that the archives of the driver tables do reach; the library defaults are far above them.
QUOTA = Quota(max_members=10, max_bytes=500_000_000)
PACK_SIZE = 200
# Bytes of a block where pages are packed from files: most pages are several blocks.
SMALL_BLOCK = 1024


# ---- accounting and routing ------------------------------------------------


def savings_by_ext(spark: SparkSession, d: str) -> DataFrame:
    return accounting.job_totals(src.results(spark, d), by=["ext"])


def job_totals(spark: SparkSession, d: str) -> DataFrame:
    return accounting.job_totals(src.results(spark, d))


def file_savings(spark: SparkSession, d: str) -> DataFrame:
    reported = src.results(spark, d).withColumn("out_size", F.when(F.col("doc_id") % 5 != 0, F.col("out_size")))
    return accounting.with_savings(reported).withColumn("saved_text", scalars.fmt1("saved_pct"))


def size_summary(spark: SparkSession, d: str) -> DataFrame:
    scale = F.expr("shiftleft(1L, cast(doc_id % 4 as int) * 10)")
    orig, out = F.col("orig_size") * scale, F.col("out_size") * scale
    return src.results(spark, d).select(
        "doc_id", scalars.human_readable(orig - out).alias("saved_text"), scalars.size_summary(orig, out).alias("summary")
    )


def route_actions(spark: SparkSession, d: str) -> DataFrame:
    return routing.route(src.estate(spark, d))


def final_actions(spark: SparkSession, d: str) -> DataFrame:
    routed = routing.route(src.results(spark, d))
    plain = routing.final_action(routed, mirror=False).withColumnRenamed("final_action", "plain_action")
    return routing.final_action(plain, mirror=True).select("doc_id", "ext", "plain_action", "final_action")


def task_union(spark: SparkSession, d: str) -> DataFrame:
    files = src.manifest(spark, d).where(routing.not_archive()).select("rel_path", "ext", "size")
    members = src.member_files(spark, d).where(routing.not_archive())
    copies = src.archives(spark, d).select("rel_path", "ext", "size")
    return routing.build_tasks(files, members, copies)


def task_join(spark: SparkSession, d: str) -> DataFrame:
    tasks = src.archives(spark, d).select(F.col("archive_path").alias("task_id"), F.col("size").alias("task_size"))
    results = src.members(spark, d).select(
        F.col("archive_path").alias("task_id"), *src.MEMBER_ORDER, F.col("file_size").alias("result_size")
    )
    return accounting.attach_tasks(results, tasks)


def keep_smaller(spark: SparkSession, d: str) -> DataFrame:
    sized = src.images(spark, d).select("doc_id", "xref", F.col("size").alias("orig_size"), "new_size")
    return routing.keep_smaller(sized)


def stage_plan(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    settings = src.manifest(spark, d).select(
        "doc_id",
        F.when(doc % 3 == 0, "gs").otherwise("native").alias("engine"),
        src.pick(["lossy", "lossless", "both", "other"], doc).alias("mode"),
        (doc % 2 == 0).alias("use_lossless"),
        F.col("size").alias("orig_size"),
    )
    return routing.plan_stages(settings)


def stage_plan_text(spark: SparkSession, d: str) -> DataFrame:
    return stage_plan(spark, d).withColumn("stages", F.array_join("stages", "+"))


def stage_outcome(spark: SparkSession, d: str) -> DataFrame:
    doc, size = F.col("doc_id"), F.col("orig_size")
    reported = stage_plan(spark, d).withColumns(
        {
            "lossy_ok": doc % 5 != 0,
            "lossy_size": F.expr("orig_size * 60 div 100"),
            "lossless_ok": doc % 7 != 0,
            "lossless_size": F.expr("orig_size * 55 div 100"),
            "gs_skipped": doc % 11 == 0,
            "gs_size": F.when(doc % 4 == 0, size + 10).otherwise(F.expr("orig_size * 70 div 100")),
        }
    )
    return routing.resolve_stages(reported).select("doc_id", "orig_size", "outcome", "ok", "out_size")


def output_plan(spark: SparkSession, d: str) -> DataFrame:
    return routing.plan_outputs(src.estate(spark, d), src.member_files(spark, d), True, True, False)


def output_plan_repack(spark: SparkSession, d: str) -> DataFrame:
    return routing.plan_outputs(src.estate(spark, d), src.member_files(spark, d), True, False, True)


def output_collisions(spark: SparkSession, d: str) -> DataFrame:
    return routing.output_collisions(output_plan(spark, d))


def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    routed = routing.final_action(routing.route(src.results(spark, d)), mirror=True)
    named = routed.withColumns(
        {"audit_input": F.col("rel_path"), "audit_output": F.col("rel_path"), "notes": F.lit(None).cast("string")}
    )
    return audit_table(named, F.lit("2024-01-02 03:04:05.000600").cast("timestamp"))


# ---- paths and scalars -----------------------------------------------------


def archive_paths(spark: SparkSession, d: str) -> DataFrame:
    planned = paths.archive_plan(src.member_files(spark, d).select("archive_path", "rel_path"), output_base="out")
    return paths.audit_paths(planned, repack=True)


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.when(F.col("doc_id") % 3 == 0, "/other/").otherwise("/data/in/"), "rel_path")
    return src.manifest(spark, d).select(
        "doc_id",
        paths.relative_path(full, "/data/in/").alias("below"),
        paths.base_name(full).alias("name"),
        paths.parent_dir(full).alias("parent"),
        paths.stem(full).alias("stem"),
        "ext",
    )


def overlapping_roots(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    folder = F.concat_ws("/", "source", "lang")
    roots = src.read(spark, d, "documents").select(
        "doc_id",
        folder.alias("input_root"),
        F.when(doc % 6 == 0, folder)
        .when(doc % 6 == 1, F.concat(folder, F.lit("/sub")))
        .when(doc % 6 == 2, F.col("source"))
        .when(doc % 6 == 3, F.concat(folder, F.lit("x")))
        .when(doc % 6 == 4, "")
        .otherwise(F.concat(folder, F.lit("/./a/../")))
        .alias("output_root"),
    )
    return paths.overlapping_roots(roots)


def resize_long_edge(spark: SparkSession, d: str) -> DataFrame:
    dims = scalars.resize_dims(F.col("width"), F.col("height"), ResizeSpec("long_edge", long_edge=400))
    return src.images(spark, d).select("doc_id", "xref", dims.alias("dims")).select("doc_id", "xref", "dims.*")


def resize_manual(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    specs = {
        "box": ResizeSpec(width=640, height=480),
        "by_w": ResizeSpec(width=333),
        "by_h": ResizeSpec(height=201),
        "free": ResizeSpec(width=300, keep_aspect=False),
        "down": ResizeSpec(width=900, height=900, allow_upscale=False),
    }
    sized = src.images(spark, d).select(
        "doc_id", "xref", *[scalars.resize_dims(w, h, spec).alias(name) for name, spec in specs.items()]
    )
    return sized.select(
        "doc_id", "xref", *[F.col(f"{n}.new_{s}").alias(f"{n}_{s}") for n in specs for s in ("w", "h")]
    )


def _form_text(events: DataFrame) -> DataFrame:
    """Texts a user might type, next to the event's own value."""
    typed = ["42", "-4", "3.8", "abc", " 5 ", "1e3", "1_000", "5d", "999999", "", "+7", "-0", "inf", ".5", "0x10"]
    return events.select(
        "event_id",
        F.when(F.col("event_id") % 16 == 15, F.col("value").cast("string"))
        .otherwise(src.pick(typed, F.col("event_id") % 16))
        .alias("typed"),
    )


def quality_clamps(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("typed")
    quality = scalars.clamp_quality(text, 75)
    band = scalars.quality_range(quality)
    custom = scalars.clamp_dpi(text)
    return _form_text(src.read(spark, d, "events")).select(
        "event_id",
        "typed",
        quality.alias("quality"),
        band.low.alias("low"),
        band.high.alias("high"),
        custom.alias("custom_dpi"),
        scalars.mono_dpi(custom).alias("mono_dpi"),
        scalars.clamp_dpi(text, 36, 600).alias("form_dpi"),
    )


def form_integers(spark: SparkSession, d: str) -> DataFrame:
    return _form_text(src.read(spark, d, "events")).select(
        "event_id", "typed", scalars.to_non_negative_int("typed", 65535).alias("edge")
    )


def error_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents taken as tool output in which two file paths occur."""
    folder = F.concat(F.lit("/tmp/job/"), "source")
    in_path = F.concat(folder, F.lit("/in.pdf"))
    out_path = F.concat(folder, F.lit("/out.pdf"))
    message = F.concat(F.lit("  cannot read "), in_path, F.lit("\n\t"), F.col("text"), F.lit(" -> "), out_path)
    return src.read(spark, d, "documents").select(
        "doc_id",
        scalars.clean_error(message, in_path, out_path).alias("error"),
        F.length(scalars.clean_error(message, in_path, out_path, limit=10_000_000)).alias("full_length"),
    )


def transparency(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") + F.col("xref")
    palette = F.when(n % 3 == 0, F.array(F.lit(255), F.col("min_level")))
    marker = F.when(n % 7 == 0, F.lit("key"))
    return src.images(spark, d).select(
        "doc_id",
        "xref",
        scalars.has_transparency(F.col("has_alpha"), F.col("min_level"), palette, marker).alias("has_transparency"),
    )


def event_stamps(spark: SparkSession, d: str) -> DataFrame:
    whole = F.when(F.col("event_id") % 2 == 0, F.date_trunc("second", "ts")).otherwise(F.col("ts"))
    return src.read(spark, d, "events").select(
        "event_id", scalars.iso_ts(whole).alias("iso"), scalars.file_stamp("ts").alias("stamp")
    )


# ---- labels ----------------------------------------------------------------


def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    lang = src.pick(src.LANGUAGE_TEXTS, F.col("event_id"))
    rows = src.read(spark, d, "events").select(
        "event_id", F.concat(F.lit("kind."), "event_type").alias("label_key"), lang.alias("lang_text")
    )
    labelled = labels.label(rows, "label_key", "lang_text", src.label_catalog(spark))
    return labelled.withColumn("lang", scalars.normalize_language("lang_text"))


def label_overlay(spark: SparkSession, d: str) -> DataFrame:
    base = src.read(spark, d, "orders").select(
        F.concat(F.lit("order."), "o_orderkey").alias("key"), F.col("o_orderpriority").alias("text")
    )
    local = (
        src.read(spark, d, "lineitem")
        .groupBy(F.concat(F.lit("order."), "l_orderkey").alias("key"))
        .agg(F.max(F.concat("l_returnflag", "l_linestatus")).alias("text"))
    )
    return labels.overlay(base, local)


def template_fill(spark: SparkSession, d: str) -> DataFrame:
    templates = ["{name}: {size} bytes", "{name} ({pct:.1f}%)", "{name} {unknown}", "plain", "{name} {"]
    return src.results(spark, d).select(
        "doc_id",
        scalars.fill_template(
            src.pick(templates, F.col("doc_id")),
            name=F.col("rel_path"),
            size=F.col("orig_size"),
            pct=scalars.fmt1(scalars.saved_pct("orig_size", "out_size")),
        ).alias("text"),
    )


def tool_labels(spark: SparkSession, d: str) -> DataFrame:
    source = src.pick(["system", "bundled", "unavailable"], F.col("xref"))
    return src.images(spark, d).select("doc_id", "xref", scalars.tool_label("quantizer", source).alias("tool"))


# ---- archives --------------------------------------------------------------


def member_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return archives.member_verdict(src.members(spark, d)).select("archive_path", *src.MEMBER_ORDER, "name", "violation")


def archive_quota(spark: SparkSession, d: str) -> DataFrame:
    return archives.archive_quota(src.members(spark, d), QUOTA)


def archive_first_violation(spark: SparkSession, d: str) -> DataFrame:
    return archives.first_violation(src.members(spark, d), QUOTA, src.MEMBER_ORDER)


def archive_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return archives.archive_outcomes(archive_first_violation(spark, d))


def repack_candidates(spark: SparkSession, d: str) -> DataFrame:
    written = src.member_files(spark, d).where(routing.compressible())
    return archives.repack_candidates(src.archives(spark, d).select("archive_path", "size"), written)


def unprocessed_archives(spark: SparkSession, d: str) -> DataFrame:
    return archives.unprocessed(src.archives(spark, d).select("archive_path", "size"), src.members(spark, d))


# ---- images in documents ---------------------------------------------------


def _placed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return src.placements(spark, d), src.images(spark, d)


def image_decisions(spark: SparkSession, d: str) -> DataFrame:
    return imageplan.image_decisions(*_placed(spark, d), order_by=src.PLACEMENT_ORDER)


def placement_status(spark: SparkSession, d: str) -> DataFrame:
    return image_decisions(spark, d).groupBy("xref", "status").agg(F.count(F.lit(1)).alias("placements"))


def image_counters(spark: SparkSession, d: str) -> DataFrame:
    documents = src.read(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("pages"))
    return imageplan.image_counters(*_placed(spark, d), order_by=src.PLACEMENT_ORDER, documents=documents)


def decision_counts(spark: SparkSession, d: str) -> DataFrame:
    return imageplan.count_decisions(image_decisions(spark, d))


def image_summary(spark: SparkSession, d: str) -> DataFrame:
    return imageplan.image_summary(image_decisions(spark, d))


def first_use_top50(spark: SparkSession, d: str) -> DataFrame:
    shown = imageplan.first_uses(*_placed(spark, d), order_by=src.PLACEMENT_ORDER)
    detail = imageplan.first_use_detail(shown, 50, src.PLACEMENT_ORDER, one_per_image=True)
    return detail.select("doc_id", *src.PLACEMENT_ORDER, "xref", "status", "detail_rank")


def mask_join(spark: SparkSession, d: str) -> DataFrame:
    return imageplan.mask_join(src.images(spark, d)).select(
        "doc_id", "xref", "soft_mask_xref", "soft_mask_applied", "soft_mask_error", "has_transparency"
    )


def distinct_lists(spark: SparkSession, d: str) -> DataFrame:
    decided = imageplan.decide_images(*_placed(spark, d), order_by=src.PLACEMENT_ORDER)
    return imageplan.distinct_list(decided, "fallback_reason", by=["doc_id"], out="reasons")


# ---- cleanup and snapshots -------------------------------------------------


def cleanup_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.plan_cleanup(src.estate(spark, d), INPUT_CLEANUP_EXTS).counts


def cleanup_everything(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.plan_cleanup(src.estate(spark, d), ()).counts


def cleanup_empty_dirs(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.plan_cleanup(src.estate(spark, d), INPUT_CLEANUP_EXTS).emptied_dirs


def target_counts(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.count_targets(src.estate(spark, d), OUTPUT_CLEANUP_EXTS)


def snapshot_select(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    plain = F.concat_ws("/", "source", "lang", F.concat((F.col("n_chars") % 10).cast("string"), F.lit(".txt")))
    path = (
        F.when(doc % 11 == 0, F.concat(F.lit("dist/"), doc))
        .when(doc % 13 == 0, "  ")
        .when(doc % 17 == 0, "Dist")
        .when(doc % 19 == 0, F.concat(F.lit("DIST/"), plain))
        .when(doc % 2 == 1, F.upper(plain))
        .otherwise(plain)
    )
    return cleanup.snapshot_select(src.read(spark, d, "documents").select(doc.alias("position"), path.alias("path")))


def tree_diff(spark: SparkSession, d: str) -> DataFrame:
    before = src.manifest(spark, d)
    kept = src.results(spark, d).where(routing.not_archive()).select("rel_path", F.col("out_size").alias("size"))
    logs = src.read(spark, d, "conversations").select(
        F.concat(F.lit("logs/"), "conv_id", F.lit("-"), "turn", F.lit(".txt")).alias("rel_path"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    return cleanup.tree_diff(before, kept.unionByName(logs))


# ---- job events ------------------------------------------------------------


def progress_rank(spark: SparkSession, d: str) -> DataFrame:
    finished = src.read(spark, d, "events").select(
        F.col("user_id").alias("job_id"), F.col("ts").alias("finished_at"), F.col("event_id").alias("task_id")
    )
    return accounting.progress(finished).select("job_id", "task_id", "current", "total", "pct")


def event_dispatch(spark: SparkSession, d: str) -> DataFrame:
    dispatched = monitor.dispatch_events(src.job_events(src.read(spark, d, "events")))
    return dispatched.withColumn("ts", scalars.iso_ts("ts"))


def job_state(spark: SparkSession, d: str) -> DataFrame:
    return monitor.job_state(src.job_events(src.read(spark, d, "events")))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = src.read(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")


def stream_job_state(spark: SparkSession, d: str) -> DataFrame:
    """The running state as a stream over the whole table, read back as its last state."""
    out, checkpoint = new_shared_path(spark, "state"), new_shared_path(spark, "state-progress")
    states = monitor.job_state(src.job_events(_event_stream(spark, d)))
    monitor.publish_state(states, out, checkpoint).awaitTermination()
    return monitor.latest_state(spark, out)


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Paths of the table as a stream, each let in once within a day, with state that expires."""
    out, checkpoint = new_shared_path(spark, "seen"), new_shared_path(spark, "seen-progress")
    paths_seen = _event_stream(spark, d).select(F.concat(F.lit("job/"), "user_id", F.lit("/"), "event_type").alias("path"))
    first = admit_paths(paths_seen, modified=None, ttl="1 day").select("path")
    first.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    for setting in SETTINGS:
        spark.conf.unset(setting)
    return spark.read.schema(first.schema).parquet(out)


def nested_roots(spark: SparkSession, d: str) -> DataFrame:
    """Which folders of the documents lie in which, among all of them and their parents."""
    doc = F.col("doc_id")
    folder = F.concat_ws("/", "source", "lang", F.expr("n_chars div 1000"))
    root = F.when(doc % 5 == 0, F.col("source")).when(doc % 5 == 1, F.concat_ws("/", "source", "lang")).when(doc % 5 == 2, F.concat(folder, F.lit("/./"))).otherwise(folder)
    return containing_roots(src.read(spark, d, "documents").select(root.alias("root")))


def tree_diff_folders(spark: SparkSession, d: str) -> DataFrame:
    """The documents with every file of some folders changed; only those folders are compared file by file."""
    before = src.manifest(spark, d).select("rel_path", "size")
    grown = F.split_part("rel_path", F.lit("/"), F.lit(3)).try_cast("bigint") % 9 == 0
    after = before.withColumn("size", F.when(grown, F.col("size") + 1).otherwise(F.col("size")))
    added = src.read(spark, d, "conversations").select(F.concat(F.lit("logs/"), "conv_id", F.lit("-"), "turn", F.lit(".txt")).alias("rel_path"), F.octet_length("text").cast("bigint").alias("size"))
    return tree_diff_by_folders(before, after.unionByName(added))


def result_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of all results, each in one of several languages."""
    lang = src.pick(src.LANGUAGE_TEXTS, F.col("doc_id"))
    return messages.result_messages(src.results(spark, d), src.message_catalog(spark), lang, base="rel_path").select("doc_id", "message")


def live_job_events(spark: SparkSession, d: str) -> DataFrame:
    """The state of a job by the events that its tasks wrote while they ran, over every page as a file."""
    folder, n = new_shared_path(spark, "events"), F.col("page_id")
    files = src.payloads(spark, d).withColumns({"ext": src.pick(["txt", "even", "bin"], n), "audit_input": n.cast("string"), "orig_size": F.octet_length("content").cast("bigint")})
    done = payloads.transform_payloads(files, {"txt": _append_line, "even": _even_only}, on_done=DoneLog(folder, "pages"))
    results = saved_table(done.drop("out_content"), "results")
    state = monitor.job_state(done_events(read_done(spark, folder, results)))
    return state.select("job_id", "files_done", "orig_total", "out_total", "errors")


# ---- payload bytes ---------------------------------------------------------


def payload_recompress(spark: SparkSession, d: str) -> DataFrame:
    """Kept bytes of every page are never more than it has, and inflate to it; exact sizes are zlib's own."""
    packed = payloads.recompress_payloads(src.payloads(spark, d), keep_original=True)
    smaller = (F.col("kept_size") <= F.col("orig_size")) & (F.octet_length(F.coalesce("out_content", "content")) == F.col("kept_size"))
    return packed.select("page_id", "path", "orig_size", F.col("accepted").eqNullSafe(F.col("new_size") < F.col("orig_size")).alias("judged"), smaller.alias("not_larger"), "ok", "error")


def payload_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Recompress, inflate again, and fingerprint what comes back."""
    packed = payloads.recompress_payloads(src.payloads(spark, d), keep_original=True)
    kind = F.when(F.col("accepted"), "deflated").otherwise("plain")
    kept = packed.select("page_id", "orig_size", kind.alias("kind"), F.coalesce("out_content", "content").alias("content"))
    restored = payloads.transform_payloads(kept, {"deflated": zlib.decompress, "plain": bytes}, key="kind")
    return restored.select("page_id", "orig_size", "ok", F.md5("out_content").alias("fingerprint"))


def _append_line(content: bytes) -> bytes:
    return content + b"\n"


def _even_only(content: bytes) -> bytes:
    if len(content) % 2:
        raise ValueError("odd length")
    return content


def payload_transform(spark: SparkSession, d: str) -> DataFrame:
    """Two handlers, one of which fails for some files, and a type nobody handles."""
    files = src.payloads(spark, d).withColumn("ext", src.pick(["txt", "even", "bin"], F.col("page_id")))
    done = payloads.transform_payloads(files, {"txt": _append_line, "even": _even_only})
    return done.select("page_id", "ext", "ok", "out_size", "error", F.md5("out_content").alias("fingerprint"))


def _packed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages grouped into archives of PACK_SIZE consecutive ids."""
    files = src.payloads(spark, d).select(
        F.concat(F.lit("pages/"), F.expr(f"page_id div {PACK_SIZE}"), F.lit(".zip")).alias("archive_path"),
        F.concat(F.lit("html/"), F.col("page_id") % 7, F.lit("/"), "page_id", F.lit(".html")).alias("rel_path"),
        "content",
    )
    return pack_archives(files).select(F.col("archive_path").alias("path"), "file_count", "content")


def archive_listing(spark: SparkSession, d: str) -> DataFrame:
    listed = list_members(_packed_pages(spark, d))
    return listed.select("archive_path", "idx", "name", "file_size", "error")


def archive_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pack all pages, unpack the archives again, and fingerprint every member."""
    members = expanded_members(expand_archives(saved_table(_packed_pages(spark, d), "packed")))
    return members.select("archive_path", "rel_path", "file_size", F.md5("payload").alias("fingerprint"))


def archive_from_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages as files of a folder, packed from their paths in blocks by many tasks, and unpacked again."""
    root = new_shared_path(spark, "sources")
    pages = src.payloads(spark, d).select(F.concat("page_id", F.lit(".html")).alias("output_path"), "content")
    saved_table(write_payloads(pages, root), "written")
    number = F.substring_index("rel_path", ".", 1).cast("bigint")
    files = list_tree(spark, root).select(
        F.concat(F.lit("pages/"), F.expr(f"cast(substring_index(rel_path, '.', 1) as bigint) div {PACK_SIZE}"), F.lit(".zip")).alias("archive_path"),
        F.concat(F.lit("html/"), number % 7, F.lit("/"), "rel_path").alias("rel_path"), F.lit(None).cast("binary").alias("content"), F.col("path").alias("source"), "size",
    )
    packed = pack_archives(files, source="source", block_bytes=SMALL_BLOCK).select(F.col("archive_path").alias("path"), "content")
    members = expanded_members(expand_archives(saved_table(packed, "packed")))
    return members.select("archive_path", "rel_path", "file_size", F.md5("payload").alias("fingerprint"))


# ---- archives that are nested, damaged or overwrite their own files -------------


def _zip_of(rows: DataFrame, group: str, name: str, content: str) -> DataFrame:
    """One archive per group, as (path, content)."""
    named = rows.select(F.col(group).alias("archive_path"), F.col(name).alias("rel_path"), F.col(content).alias("content"))
    return saved_table(pack_archives(named).select(F.col("archive_path").alias("path"), "content"), "packed")


def _nested_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages in archives of PACK_SIZE, and those by fives in outer archives."""
    inner = _packed_pages(spark, d)
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
    named = inner.select(
        F.concat(F.lit("outer/"), F.floor(number / 5), F.lit(".zip")).alias("group"), F.concat(F.lit("in/"), number, F.lit("/part.zip")).alias("name"), "content"
    )
    return _zip_of(named, "group", "name", "content")


def nested_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Archives in archives, unpacked again: every page comes back beside the archive that held it."""
    members = expanded_members(expand_archives(_nested_pages(spark, d)))
    return members.select("archive_path", "container", "rel_path", "depth", F.md5("payload").alias("fingerprint"))


def unopened_depth(spark: SparkSession, d: str) -> DataFrame:
    """The same with a limit of one level: each inner archive is a failed one, and none of its pages is lost silently."""
    verdicts = expanded_verdicts(expand_archives(_nested_pages(spark, d), max_depth=1))
    return verdicts.select("archive_path", "container", "depth", "member_count", "violation")


def _damage_first_byte(content: bytes) -> bytes:
    """Changes the first packed byte of the first file, so that its checksum fails."""
    at, out = 0, bytearray(content)
    while out[at : at + 4] == b"PK\x03\x04":
        size = int.from_bytes(out[at + 18 : at + 22], "little")
        start = at + 30 + int.from_bytes(out[at + 26 : at + 28], "little")
        if size:
            out[start] ^= 0xFF
            break
        at = start
    return bytes(out)


def damaged_members(spark: SparkSession, d: str) -> DataFrame:
    """One member of each archive damaged on purpose: it is reported, all others come back."""
    broken = payloads.transform_payloads(_packed_pages(spark, d).withColumn("kind", F.lit("zip")), {"zip": _damage_first_byte}, key="kind")
    broken = saved_table(broken.select("path", F.col("out_content").alias("content")), "packed")
    expanded = saved_table(expand_archives(broken), "expanded")
    lost = unreadable_members(expanded).groupBy("archive_path").agg(F.count(F.lit(1)).alias("unreadable"))
    read = expanded_members(expanded).groupBy("archive_path").agg(F.count(F.lit(1)).alias("readable"))
    verdicts = expanded_verdicts(expanded).select("archive_path", "violation")
    return verdicts.join(lost, "archive_path", "left").join(read, "archive_path", "left")


def member_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Every archive holds pages and an archive with newer versions of the same: the inner ones are written last."""
    pages = src.payloads(spark, d).select(
        F.concat(F.lit("twice/"), F.expr(f"page_id div {PACK_SIZE}"), F.lit(".zip")).alias("group"), F.concat("page_id", F.lit(".html")).alias("name"), "content"
    )
    newer = pages.where(F.substring_index("name", ".", 1).cast("bigint") % 2 == 0).withColumn("content", F.concat("content", F.lit("<!-- new -->").cast("binary")))
    inner = _zip_of(newer, "group", "name", "content").select(F.col("path").alias("group"), F.lit("update.zip").alias("name"), "content")
    members = expanded_members(expand_archives(_zip_of(pages.unionByName(inner), "group", "name", "content")))
    return members.select("archive_path", "rel_path", "depth", F.md5("payload").alias("fingerprint"))


# ---- folders, audit tables and label files ---------------------------------------


def folder_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Pages written as files into the shared folder, scanned and read back."""
    root = new_shared_path(spark, "folder")
    named = src.payloads(spark, d).select(F.concat(F.lit("p"), F.col("page_id") % 10, F.lit("/"), "page_id", F.lit(".html")).alias("output_path"), "content")
    write_committed(named, root)
    files = scan_files(spark, root, with_content=True)
    return files.select("rel_path", "name", "ext", "size", F.md5("content").alias("fingerprint"))


def folder_intake(spark: SparkSession, d: str) -> DataFrame:
    """The same files as a stream of new ones."""
    root, out, checkpoint = (new_shared_path(spark, label) for label in ("intake", "taken", "taken-progress"))
    named = src.payloads(spark, d).select(F.concat("page_id", F.lit(".html")).alias("output_path"), "content")
    saved_table(write_payloads(named, root), "written")
    stream = monitor.watch_folder(spark, root).select(F.substring_index("path", "/", -1).alias("name"), "ext", "size", F.md5("content").alias("fingerprint"))
    with monitor.few_listing_tasks(spark):
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _written_pages(spark: SparkSession, d: str) -> str:
    """Root of a folder with every page as a file; every third folder and every fifth file has a hidden name."""
    root, n = new_shared_path(spark, "folder"), F.col("page_id")
    folder = F.concat(F.when(n % 3 == 0, "_x").otherwise("d"), n % 12, F.lit("/"))
    name = F.concat(F.when(n % 5 == 0, ".").otherwise(""), n, src.pick([".html", ".HTM", ""], n))
    saved_table(write_payloads(src.payloads(spark, d).select(F.concat(folder, name).alias("output_path"), "content"), root), "written")
    return root


def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    """The folder source with tests on type and size, which are decided where files are listed."""
    register_folder_sources(spark)
    files = spark.read.format(FOLDER_FORMAT).load(_written_pages(spark, d))
    return files.where(F.col("ext").isin("html", "htm") & (F.col("size") > 1000)).select("rel_path", "name", "ext", "size")


def folder_changes(spark: SparkSession, d: str) -> DataFrame:
    """The folder as a stream: all files, hidden ones too, then, started again, only those that are new or changed."""
    register_folder_sources(spark)
    root, out, checkpoint = _written_pages(spark, d), new_shared_path(spark, "taken"), new_shared_path(spark, "taken-progress")
    stream = spark.readStream.format(INTAKE_FORMAT).load(root).select("path", "rel_path", "size")

    def take() -> None:
        query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()

    take()
    time.sleep(0.01)  # A change at the very time of the last file could not be told from it.
    n = F.col("page_id")
    changed = src.payloads(spark, d).where(n % 4 == 0).select(F.concat(F.lit("late/"), n).alias("output_path"), F.concat("content", "content").alias("content"))
    saved_table(write_payloads(changed, root), "written")
    take()
    taken = read_contents(spark.read.schema(stream.schema).parquet(out))
    return taken.select("rel_path", "size", F.md5("content").alias("fingerprint"))


def _header(page: Column, html: Column) -> Column:
    """First bytes of a picture with the page's number as its width and the length of its text as its height."""
    four = lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")
    two = lambda c: F.lpad(F.hex(c.cast("bigint")), 4, "0")
    width, height = page % 4000 + 1, F.length(html) % 60000 + 1
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(width), four(height), F.when(page % 2 == 0, "0806").otherwise("0802"), F.lit("00000000000000"))
    segment = F.concat(F.lit("FFD8FFE1"), two(F.length(html) % 60000 + 2), F.hex(F.substring(html.cast("binary"), F.lit(1), F.length(html) % 60000)))
    jpeg = F.concat(F.lit("FFD8FFE10002"), F.lit("FFC0001108"), two(height), two(width), F.when(page % 2 == 0, "03").otherwise("01"), F.lit("011100"))
    return F.unhex(F.when(page % 3 == 0, png).when(page % 3 == 1, jpeg).otherwise(segment))


def image_headers(spark: SparkSession, d: str) -> DataFrame:
    """Pictures made of pages, written as files; their sizes are read from headers. Every third is no picture."""
    root, pages = new_shared_path(spark, "pictures"), src.read(spark, d, "pages")
    name = F.concat(F.lit("p"), F.col("page_id") % 7, F.lit("/"), "page_id", src.pick([".png", ".JPG", ".jpeg"], F.col("page_id")))
    saved_table(write_payloads(pages.select(name.alias("output_path"), _header(F.col("page_id"), F.col("html")).alias("content")), root), "written")
    found = scan_images(spark, root)
    return found.select(F.substring_index("path", "/", -2).alias("name"), "ext", "width", "height", "channels", "mode", "decodable")


def _written_archives(spark: SparkSession, packed: DataFrame) -> DataFrame:
    """Archives written as files and found again by a scan, without their contents."""
    root = new_shared_path(spark, "archives")
    saved_table(write_payloads(packed.select(F.col("path").alias("output_path"), "content"), root), "written")
    return scan_archives(spark, root, with_content=False)


def archive_scan(spark: SparkSession, d: str) -> DataFrame:
    """Directories of archives in a folder, by ranged reads."""
    listed = list_members(_written_archives(spark, _packed_pages(spark, d)), "rel_path", source="path")
    return listed.select("archive_path", "idx", "name", "file_size", "error")


def nested_files(spark: SparkSession, d: str) -> DataFrame:
    """Nested archives in a folder: members by ranged reads, by their offsets."""
    archives = _written_archives(spark, _nested_pages(spark, d))
    members = expanded_members(expand_archives(archives, path="rel_path", source="path"))
    return members.select("archive_path", "container", "rel_path", "depth", F.md5("payload").alias("fingerprint"))


def output_plan_settings(spark: SparkSession, d: str) -> DataFrame:
    """How many paths each of the settings of extract, mirror and repack writes, by origin, and a checksum of them."""
    names, settings = ("extract", "mirror", "repack"), list(itertools.product((False, True), repeat=3))
    plan = routing.plan_outputs_each(src.estate(spark, d), src.member_files(spark, d), settings)
    wanted = [F.when(F.getbit("written_by", F.lit(i)) == 1, F.struct(*[F.lit(v).alias(c) for c, v in zip(names, s, strict=True)])) for i, s in enumerate(settings)]

    def by_setting(rows: DataFrame, *figures: Column) -> DataFrame:
        """Of a few rows per origin and set of settings, figures for each setting."""
        each = rows.withColumn("_s", F.explode(F.array(*wanted))).where("_s is not null")
        return each.select("_s.*", *[c for c in rows.columns if c != "written_by"]).groupBy(*names, "origin").agg(*figures)

    # Only (origin, path) and a number are shuffled, once for all settings.
    letters = F.sum(F.length("output_path") + F.length("source_path")).alias("letters")
    rows = plan.groupBy("origin", "written_by").agg(F.count(F.lit(1)).alias("paths"), letters)
    distinct = plan.groupBy("origin", "output_path").agg(F.bit_or("written_by").alias("written_by")).groupBy("origin", "written_by")
    ends = distinct.agg(F.count(F.lit(1)).alias("distinct_paths"), F.min("output_path").alias("first_path"), F.max("output_path").alias("last_path"))
    counted = by_setting(rows, F.sum("paths").alias("paths"), F.sum("letters").alias("letters"))
    found = by_setting(ends, F.sum("distinct_paths").alias("distinct_paths"), F.min("first_path").alias("first_path"), F.max("last_path").alias("last_path"))
    return counted.join(found, [*names, "origin"]).select(*names, "origin", "paths", "distinct_paths", "letters", "first_path", "last_path")


def audit_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The audit table written as CSV into the shared folder and read back."""
    path = new_shared_path(spark, "audit")
    write_audit(audit_rows(spark, d), path)
    return read_audit(spark, path)


#: Numbers of parts that share a label catalog.
CATALOG_PARTS = 1000


def labels_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Label files of two languages, made of all parts, written as JSON and read back as catalogs of bounded size."""
    root = new_shared_path(spark, "labels")
    number = F.col("p_partkey")
    parts = src.read(spark, d, "part").select(F.expr(f"p_partkey div {CATALOG_PARTS}").alias("catalog"), number, F.concat(F.lit("part_"), number).alias("key"), F.col("p_name").alias("text"))
    both = parts.withColumn("lang", F.explode(F.when(number % 3 == 0, F.array(F.lit("en"), F.lit("ja"))).otherwise(F.array(F.lit("en")))))
    entries = F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "text")))).cast("binary")
    files = both.groupBy("catalog", "lang").agg(entries.alias("content"))
    saved_table(write_payloads(files.select(F.concat("catalog", F.lit("/"), "lang", F.lit(".json")).alias("output_path"), "content"), root), "written")
    return read_labels(spark, f"{root}/*")


def observed_totals(spark: SparkSession, d: str) -> DataFrame:
    """Counts of all results, observed while they are written for something else."""
    counted, observation = monitor.observed(src.results(spark, d))
    counted.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([observation.get], "files_done bigint, orig_total bigint, out_total bigint")


QUERIES = {
    f.__name__: f
    for f in (
        savings_by_ext, job_totals, file_savings, size_summary, route_actions, final_actions, task_union, task_join,
        keep_smaller, stage_plan_text, stage_outcome, output_plan, output_plan_repack, output_collisions, audit_rows,
        archive_paths, relative_paths, overlapping_roots, resize_long_edge, resize_manual, quality_clamps,
        form_integers, error_cleanup, transparency, event_stamps, label_lookup, label_overlay, template_fill,
        tool_labels, member_verdicts, archive_quota, archive_first_violation, archive_outcomes, repack_candidates,
        unprocessed_archives, image_decisions, placement_status, image_counters, decision_counts, image_summary,
        first_use_top50, mask_join, distinct_lists, cleanup_counts, cleanup_everything, cleanup_empty_dirs,
        target_counts, snapshot_select, tree_diff, progress_rank, event_dispatch, job_state, stream_job_state,
        stream_dedupe, payload_recompress, payload_roundtrip, payload_transform, archive_listing, archive_roundtrip, archive_from_files,
        nested_expansion, unopened_depth, damaged_members, member_collisions, folder_roundtrip, folder_intake, audit_roundtrip,
        folder_listing, folder_changes, nested_roots, tree_diff_folders, result_messages, live_job_events, image_headers, archive_scan, nested_files, output_plan_settings,
        labels_roundtrip, observed_totals,
    )
}
QUERIES["stage_plan"] = QUERIES.pop("stage_plan_text")
