"""Independent SQL restatements of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from shrinkwise.plans.adapters import (
    IMAGE_EXTS,
    LABELS,
    LANGUAGE_TEXTS,
    MEMBER_SUFFIXES,
    REGULAR_ATTR,
    SUFFIXES,
    SYMLINK_ATTR,
)
from shrinkwise.plans.queries import PACK_SIZE, QUOTA

COMPRESSIBLE = "('pdf', 'jpg', 'jpeg', 'png')"


def _pick(items: list[str], n: str) -> str:
    options = ", ".join(f"'{i}'" for i in items)
    return f"[{options}][CAST(({n}) % {len(items)} AS INT) + 1]"


def _ext(name: str) -> str:
    return f"lower(regexp_extract({name}, '[^/]\\.([^./]+)$', 1))"


MANIFEST = f"""
manifest AS (
  SELECT doc_id, rel_path, {_ext("rel_path")} AS ext, size FROM (
    SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size,
           source || '/' || lang || '/' || (n_chars // 1000) || '/' || doc_id || {_pick(SUFFIXES, "doc_id")} AS rel_path
    FROM documents))"""

RESULTS = f"""{MANIFEST},
results AS (
  SELECT doc_id, rel_path, ext, size AS orig_size,
         CAST(CASE doc_id % 5 WHEN 0 THEN size WHEN 1 THEN size + size // 10
              ELSE size * (40 + doc_id % 50) // 100 END AS BIGINT) AS out_size,
         ext IN {COMPRESSIBLE} AND doc_id % 10 <> 9 AS processed
  FROM manifest)"""

MEMBERS = f"""
members AS (
  SELECT 'archives/' || l_orderkey || '.zip' AS archive_path,
         l_linenumber AS idx, l_partkey AS idx_part, l_suppkey AS idx_supp,
         CASE l_partkey % 97 WHEN 0 THEN '../x' WHEN 1 THEN '/abs/x' WHEN 2 THEN 'C:/x' WHEN 3 THEN '..\\x'
              ELSE 'dir' || l_linenumber || '/' || l_partkey || {_pick(MEMBER_SUFFIXES, "l_suppkey")} END AS name,
         CAST(floor(l_extendedprice * 1000) AS BIGINT) AS file_size,
         CASE WHEN l_suppkey % 89 = 0 THEN {SYMLINK_ATTR} ELSE {REGULAR_ATTR} END AS external_attr
  FROM lineitem)"""

MEMBER_FILES = f"""{MEMBERS},
member_files AS (
  SELECT archive_path, name AS rel_path, {_ext("name")} AS ext, file_size AS size FROM members)"""

ARCHIVES = """
archives AS (
  SELECT 'archives/' || o_orderkey || '.zip' AS archive_path, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)"""

ESTATE = f"""{MANIFEST},{ARCHIVES},
estate AS (
  SELECT rel_path, ext, size FROM manifest
  UNION ALL SELECT archive_path, 'zip', size FROM archives)"""

VERDICTS = f"""{MEMBERS},
verdicts AS (
  SELECT *,
    CASE WHEN (external_attr >> 16) & 61440 = 40960 THEN 'symlink'
         WHEN slashed LIKE '/%' THEN 'absolute_path'
         WHEN list_contains(parts, '..') THEN 'path_traversal'
         WHEN len(parts) > 0 AND contains(parts[1], ':') THEN 'drive_path' END AS violation
  FROM (SELECT *, replace(name, '\\', '/') AS slashed,
               list_filter(string_split(replace(name, '\\', '/'), '/'), lambda p: p NOT IN ('', '.')) AS parts
        FROM members))"""

FIRST_VIOLATION = f"""{VERDICTS},
running AS (
  SELECT *, count(*) OVER (PARTITION BY archive_path) AS n,
         sum(file_size) OVER (PARTITION BY archive_path ORDER BY idx, idx_part, idx_supp
                              ROWS UNBOUNDED PRECEDING) AS so_far,
         row_number() OVER (PARTITION BY archive_path ORDER BY idx, idx_part, idx_supp) AS pos
  FROM verdicts),
reasons AS (
  SELECT *, CASE WHEN n > {QUOTA.max_members} THEN 'member_count'
                 WHEN so_far > {QUOTA.max_bytes} THEN 'total_size' ELSE violation END AS reason FROM running),
checked AS (
  SELECT archive_path, count(*) AS member_count, CAST(sum(file_size) AS BIGINT) AS total_bytes,
         arg_min(reason, pos) FILTER (reason IS NOT NULL) AS violation,
         arg_min(CASE WHEN reason <> 'member_count' THEN name END, pos) FILTER (reason IS NOT NULL) AS violating_member
  FROM reasons GROUP BY archive_path)"""

PLACEMENTS = """
placements AS (
  SELECT l_partkey AS doc_id, l_linenumber AS page, l_orderkey AS seq, l_suppkey AS slot, l_suppkey % 14 - 1 AS xref,
         (l_quantity - 1) * 10 AS rect_w, l_quantity * 10 AS rect_h
  FROM lineitem)"""

IMAGES = f"""
images AS (
  SELECT p_partkey AS doc_id, CAST(i AS BIGINT) AS xref, {_pick(IMAGE_EXTS, "n")} AS ext,
         CAST(CASE WHEN n % 11 = 0 THEN -1 ELSE p_size * 100 END AS INT) AS width,
         CAST(floor(p_retailprice) AS INT) AS height, CAST(p_size AS BIGINT) * 1000 AS size,
         n % 5 = 0 AS has_alpha, CAST(CASE WHEN i % 3 = 0 OR i = 11 THEN i + 1 ELSE 0 END AS BIGINT) AS smask,
         CAST(CASE WHEN n % 4 = 0 THEN 255 ELSE n % 255 END AS INT) AS min_level,
         CAST(p_size AS BIGINT) * 100 * (n % 12) AS new_size, n % 9 = 0 AS is_cmyk,
         CASE WHEN n % 2 = 1 THEN 'palette' ELSE 'pngquant' END AS quantizer,
         CASE WHEN n % 2 = 1 THEN CASE WHEN n % 3 = 0 THEN 'pngquant_timeout' ELSE 'pngquant_unavailable' END END
           AS fallback_reason
  FROM (SELECT *, p_partkey + i AS n FROM part, unnest(range(1, 12)) AS objects(i)))"""

MASKED = f"""{IMAGES},
masked AS (
  SELECT b.*, CASE WHEN b.smask > 0 THEN b.smask ELSE 0 END AS soft_mask_xref,
         coalesce(b.smask > 0 AND m.width > 0 AND m.height > 0, false) AS soft_mask_applied,
         CASE WHEN b.smask > 0 AND m.xref IS NULL THEN 'smask_extract_failed'
              WHEN b.smask > 0 AND NOT (m.width > 0 AND m.height > 0) THEN 'smask_open_failed' END AS soft_mask_error,
         CASE WHEN b.smask > 0 AND m.width > 0 AND m.height > 0 THEN m.min_level < 255 ELSE b.has_alpha END
           AS has_transparency
  FROM images b LEFT JOIN images m ON m.doc_id = b.doc_id AND m.xref = b.smask AND b.smask > 0)"""

DECISIONS = f"""{PLACEMENTS},{MASKED},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, seq, slot) AS use_no FROM placements),
first_uses AS (
  SELECT p.doc_id, p.xref, p.rect_w, p.rect_h, lower(i.ext) AS ext, i.width, i.height, i.size, i.new_size,
         i.has_transparency, i.soft_mask_xref, i.soft_mask_applied, i.soft_mask_error, i.is_cmyk, i.quantizer,
         i.fallback_reason,
         CASE WHEN NOT (p.rect_w > 0 AND p.rect_h > 0) THEN 'zero_rect'
              WHEN i.xref IS NULL THEN 'no_extract'
              WHEN lower(i.ext) IN ('jbig2', 'jpx') THEN 'unsupported_ext'
              WHEN NOT (i.width > 0 AND i.height > 0) THEN 'pil_open_failed'
              WHEN i.new_size < i.size THEN 'replaced' ELSE 'not_smaller' END AS result
  FROM ranked p LEFT JOIN masked i ON i.doc_id = p.doc_id AND i.xref = p.xref
  WHERE p.use_no = 1 AND p.xref > 0),
planned AS (
  SELECT *, result NOT IN ('zero_rect', 'no_extract') AS extracted,
         result IN ('replaced', 'not_smaller') AS opened,
         CASE WHEN result IN ('replaced', 'not_smaller')
              THEN greatest(width / (rect_w / 72.0), height / (rect_h / 72.0)) END AS dpi
  FROM first_uses),
decided AS (
  SELECT doc_id, xref, result, is_cmyk, quantizer, fallback_reason, opened,
         CASE WHEN extracted THEN ext END AS ext, CASE WHEN opened THEN width END AS orig_w,
         CASE WHEN opened THEN height END AS orig_h, dpi AS effective_dpi, dpi > 150 AS resized,
         CASE WHEN dpi > 150 THEN greatest(1, CAST(trunc(width * (150 / dpi)) AS INT)) WHEN opened THEN width END AS new_w,
         CASE WHEN dpi > 150 THEN greatest(1, CAST(trunc(height * (150 / dpi)) AS INT)) WHEN opened THEN height END AS new_h,
         CASE WHEN opened THEN has_transparency END AS has_transparency,
         CASE WHEN opened THEN soft_mask_xref END AS soft_mask_xref,
         CASE WHEN opened THEN soft_mask_applied END AS soft_mask_applied,
         CASE WHEN opened THEN soft_mask_error END AS soft_mask_error,
         CASE WHEN extracted THEN size END AS orig_size, CASE WHEN opened THEN new_size END AS new_size,
         CASE WHEN opened THEN CASE WHEN ext IN ('png', 'bmp', 'tiff', 'tif', 'gif') OR has_transparency
              THEN 'PNG' ELSE 'JPEG' END END AS output_format
  FROM planned),
labelled AS (
  SELECT r.doc_id, r.page, r.seq, r.slot, r.xref, r.rect_w, r.rect_h, r.xref > 0 AND r.use_no = 1 AS first_use,
         CASE WHEN r.xref <= 0 THEN 'skip_xref_missing'
              WHEN r.use_no > 1 THEN 'skip_already_processed:' || d.result
              WHEN d.result = 'replaced' THEN d.result ELSE 'skip_' || d.result END AS status,
         d.* EXCLUDE (doc_id, xref, result, is_cmyk, quantizer, fallback_reason, opened)
  FROM ranked r LEFT JOIN decided d ON d.doc_id = r.doc_id AND d.xref = r.xref)"""

DETAIL = (
    "ext orig_w orig_h effective_dpi resized new_w new_h has_transparency soft_mask_xref soft_mask_applied "
    "soft_mask_error orig_size new_size output_format"
).split()

COUNTERS = (
    "image_infos_seen unique_xrefs_seen skip_xref_missing skip_already_processed skip_zero_rect skip_no_extract "
    "skip_unsupported_ext skip_pil_open_failed skip_not_smaller replaced cmyk_converted soft_mask_seen "
    "soft_mask_applied soft_mask_failed pngquant_used pillow_png_fallback_used"
).split()

JOB_EVENTS = """
job_events AS (
  SELECT event_id, user_id AS job_id, ts,
         CASE event_type WHEN 'click' THEN 'log' WHEN 'view' THEN 'progress' WHEN 'purchase' THEN 'stats'
              WHEN 'signup' THEN 'status' ELSE 'error' END AS kind,
         CASE WHEN event_id % 7 <> 0 THEN props END AS message,
         CASE WHEN event_id % 5 <> 0 THEN event_id END AS current, event_id + user_id AS total,
         CAST(floor(value * 100) AS BIGINT) AS orig_total, CAST(floor(value * 60) AS BIGINT) AS out_total
  FROM events),
job_events_full AS (
  SELECT *, orig_total - out_total AS saved,
         CASE WHEN orig_total > 0 THEN (orig_total - out_total) / orig_total * 100 END AS saved_pct
  FROM job_events)"""

TYPED = ["42", "-4", "3.8", "abc", " 5 ", "1e3", "1_000", "5d", "999999", "", "+7", "-0", "inf", ".5", "0x10"]
TYPED_EVENTS = f"""
typed_events AS (
  SELECT event_id, CASE WHEN event_id % 16 = 15 THEN CAST(value AS VARCHAR)
         ELSE {_pick(TYPED, "event_id % 16")} END AS typed FROM events),
parsed AS (
  SELECT *, CASE WHEN regexp_full_match(trim(typed), '[+-]?[0-9]+(_[0-9]+)*')
                 THEN CAST(replace(trim(typed), '_', '') AS BIGINT) END AS whole,
         CASE WHEN regexp_full_match(trim(typed),
                '[+-]?([0-9]+(_[0-9]+)*(\\.([0-9]+(_[0-9]+)*)?)?|\\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?')
              THEN CAST(replace(trim(typed), '_', '') AS DOUBLE) END AS number
  FROM typed_events)"""


def _pct(orig: str, out: str) -> str:
    return f"CASE WHEN {orig} > 0 THEN ({orig} - {out}) / {orig} * 100 ELSE 0.0 END"


def _human(n: str) -> str:
    size = f"abs(CAST({n} AS DOUBLE))"
    steps = [
        f"WHEN {size} < {1024 ** (k + 1)} THEN printf('%.1f', {size} / {1024**k}) || '{unit}'"
        for k, unit in enumerate(("B", "KB", "MB", "GB", "TB"))
    ]
    return (
        f"CASE WHEN {n} < 0 THEN '-' ELSE '' END || CASE {' '.join(steps)} "
        f"ELSE printf('%.1f', {size} / {1024**5}) || 'PB' END"
    )


def _totals(by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {keys}processed_files, orig_total, out_total, orig_total - out_total AS saved,
           {_pct("orig_total", "out_total")} AS saved_pct
    FROM (SELECT {keys}count(*) AS processed_files, CAST(coalesce(sum(orig_size), 0) AS BIGINT) AS orig_total,
                 CAST(coalesce(sum(out_size), 0) AS BIGINT) AS out_total
          FROM results WHERE processed {group})"""


ROUTE = """CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' WHEN ext = 'png' THEN 'png'
           ELSE 'none' END"""
ACTION = """CASE WHEN ext = 'pdf' THEN 'csv_action_pdf' WHEN ext IN ('jpg', 'jpeg') THEN 'csv_action_jpeg'
            WHEN ext = 'png' THEN 'csv_action_png' ELSE 'csv_action_failed' END"""
MIRROR_ACTION = f"""CASE WHEN processed THEN {ACTION} WHEN ext NOT IN {COMPRESSIBLE} THEN 'csv_action_non_target_copy'
            ELSE 'csv_action_fallback_copy' END"""
ENGINE = "CASE WHEN doc_id % 3 = 0 THEN 'gs' ELSE 'native' END"
MODE = _pick(["lossy", "lossless", "both", "other"], "doc_id")
STAGES = f"""CASE WHEN {ENGINE} = 'gs' THEN CASE WHEN doc_id % 2 = 0 THEN 'gs+lossless' ELSE 'gs' END
             WHEN {MODE} IN ('lossy', 'lossless') THEN {MODE} ELSE 'lossy+lossless' END"""

STAGE_REPORTS = f"""{MANIFEST},
reports AS (
  SELECT doc_id, size AS orig_size, {STAGES} AS stages, doc_id % 5 <> 0 AS lossy_ok, size * 60 // 100 AS lossy_size,
         doc_id % 7 <> 0 AS lossless_ok, size * 55 // 100 AS lossless_size, doc_id % 11 = 0 AS gs_skipped,
         CASE WHEN doc_id % 4 = 0 THEN size + 10 ELSE size * 70 // 100 END AS gs_size
  FROM manifest),
outcomes AS (
  SELECT *, CASE stages
    WHEN 'lossy' THEN CASE WHEN lossy_ok THEN 'lossy' ELSE 'failed' END
    WHEN 'lossless' THEN CASE WHEN lossless_ok THEN 'lossless' ELSE 'failed' END
    WHEN 'lossy+lossless' THEN CASE WHEN lossy_ok AND lossless_ok THEN 'lossy+lossless' WHEN lossy_ok THEN 'lossy_kept'
                                    WHEN lossless_ok THEN 'lossless_on_original' ELSE 'failed' END
    WHEN 'gs' THEN CASE WHEN gs_skipped OR gs_size >= orig_size THEN 'original_kept' ELSE 'gs' END
    ELSE CASE WHEN gs_skipped THEN 'original_kept'
              WHEN lossless_ok AND gs_size >= orig_size THEN 'original+lossless' WHEN lossless_ok THEN 'gs+lossless'
              WHEN gs_size >= orig_size THEN 'original_kept' ELSE 'gs_kept' END END AS outcome
  FROM reports)"""

FOLDER = "regexp_replace(archive_path, '\\.zip$', '')"
LABEL_ROWS = ", ".join(f"('{lang}', '{key}', '{text}')" for lang, key, text in LABELS)
PACKED_PAGES = f"""
packed AS (
  SELECT page_id, 'pages/' || (page_id // {PACK_SIZE}) || '.zip' AS archive_path,
         'html/' || (page_id % 7) || '/' || page_id || '.html' AS rel_path, html FROM pages)"""

OUTPUT_PLAN = f"""{ESTATE},{MEMBER_FILES},
plan AS (
  SELECT rel_path AS output_path, 'file' AS origin, rel_path AS source_path FROM estate WHERE ext <> 'zip'
  UNION ALL SELECT rel_path, 'archive_copy', rel_path FROM estate WHERE ext = 'zip'
  UNION ALL SELECT {FOLDER} || '/' || rel_path, 'member', archive_path || '::' || rel_path
            FROM member_files WHERE ext <> 'zip')"""


def _settings_plan() -> str:
    """Written paths under all settings of extract, mirror and repack."""
    parts = []
    for bits in range(8):
        extract, mirror, repack = bits & 4, bits & 2, bits & 1
        head = f"SELECT {bool(extract)} AS extract, {bool(mirror)} AS mirror, {bool(repack)} AS repack, "
        kept = "" if mirror else f" AND ext IN {COMPRESSIBLE}"
        parts.append(f"{head} rel_path AS output_path, 'file' AS origin, rel_path AS source_path FROM estate WHERE ext <> 'zip'{kept}")
        if mirror and not (extract and repack):
            parts.append(f"{head} rel_path, 'archive_copy', rel_path FROM estate WHERE ext = 'zip'")
        if extract and repack:
            parts.append(f"{head} archive_path, 'repacked_archive', archive_path FROM (SELECT DISTINCT archive_path FROM member_files WHERE ext <> 'zip'{kept})")
        elif extract:
            parts.append(f"{head} {FOLDER} || '/' || rel_path, 'member', archive_path || '::' || rel_path FROM member_files WHERE ext <> 'zip'{kept}")
    return " UNION ALL ".join(parts)


def _resize(name: str, spec: str) -> str:
    """Width and height columns of one resize setting; blank for unreadable images."""
    width, height = {
        "box": ("CAST(trunc(width * least(640 / width, 480 / height)) AS INT)", "CAST(trunc(height * least(640 / width, 480 / height)) AS INT)"),
        "by_w": ("333", "CAST(trunc(height * (333 / width)) AS INT)"),
        "by_h": ("CAST(trunc(width * (201 / height)) AS INT)", "201"),
        "free": ("300", "height"),
        "down": (
            "CASE WHEN least(900 / width, 900 / height) > 1 THEN width ELSE CAST(trunc(width * least(900 / width, 900 / height)) AS INT) END",
            "CASE WHEN least(900 / width, 900 / height) > 1 THEN height ELSE CAST(trunc(height * least(900 / width, 900 / height)) AS INT) END",
        ),
        "edge": ("CAST(trunc(width * (400 / greatest(width, height))) AS INT)", "CAST(trunc(height * (400 / greatest(width, height))) AS INT)"),
    }[spec]
    return (
        f"CASE WHEN width > 0 THEN greatest(1, {width}) END AS {name}_w, "
        f"CASE WHEN width > 0 THEN greatest(1, {height}) END AS {name}_h"
    )


def _job_state() -> str:
    return f"""WITH {JOB_EVENTS}
    SELECT job_id, count(*) FILTER (kind = 'progress') AS files_done,
           CAST(coalesce(sum(orig_total) FILTER (kind = 'stats'), 0) AS BIGINT) AS orig_total,
           CAST(coalesce(sum(out_total) FILTER (kind = 'stats'), 0) AS BIGINT) AS out_total,
           max({{'ts': ts, 'id': event_id, 'm': message}}) FILTER (kind = 'status' AND message IS NOT NULL)['m']
             AS latest_status,
           count(*) FILTER (kind = 'error') AS errors
    FROM job_events GROUP BY job_id"""


ORACLE = {
    "savings_by_ext": f"WITH {RESULTS} {_totals('ext')}",
    "job_totals": f"WITH {RESULTS} {_totals()}",
    "file_savings": f"""WITH {RESULTS},
      filled AS (SELECT * REPLACE (CASE WHEN doc_id % 5 <> 0 THEN out_size ELSE orig_size END AS out_size) FROM results)
      SELECT *, orig_size - out_size AS saved_bytes, {_pct("orig_size", "out_size")} AS saved_pct,
             printf('%.1f', {_pct("orig_size", "out_size")}) AS saved_text FROM filled""",
    "size_summary": f"""WITH {RESULTS},
      big AS (SELECT doc_id, orig_size * CAST(pow(1024, doc_id % 4) AS BIGINT) AS o,
                     out_size * CAST(pow(1024, doc_id % 4) AS BIGINT) AS n FROM results)
      SELECT doc_id, {_human("(o - n)")} AS saved_text,
             'Before: ' || {_human("o")} || ' -> After: ' || {_human("n")} ||
             CASE WHEN o > n THEN ' (saved: ' || {_human("abs(o - n)")} || ', -' || printf('%.1f', {_pct("o", "n")}) || '%)'
                  WHEN o < n THEN ' (increased: ' || {_human("abs(o - n)")} || ', +' || printf('%.1f', abs({_pct("o", "n")})) || '%)'
                  ELSE ' (no change)' END AS summary FROM big""",
    "route_actions": f"WITH {ESTATE} SELECT *, {ROUTE} AS handler, {ACTION} AS action_key FROM estate",
    "final_actions": f"""WITH {RESULTS}
      SELECT doc_id, ext, CASE WHEN processed THEN {ACTION} ELSE 'csv_action_failed' END AS plain_action,
             {MIRROR_ACTION} AS final_action FROM results""",
    "task_union": f"""WITH {MANIFEST},{ARCHIVES},{MEMBER_FILES}
      SELECT rel_path, ext, size, 'file' AS origin, NULL AS archive_path FROM manifest WHERE ext <> 'zip'
      UNION ALL SELECT rel_path, ext, size, 'member', archive_path FROM member_files WHERE ext <> 'zip'
      UNION ALL SELECT archive_path, 'zip', size, 'archive_copy', NULL FROM archives""",
    "task_join": f"""WITH {MEMBERS},{ARCHIVES}
      SELECT m.archive_path AS task_id, idx, idx_part, idx_supp, file_size AS result_size, a.size AS task_size
      FROM members m JOIN archives a USING (archive_path)""",
    "keep_smaller": f"""WITH {IMAGES}
      SELECT doc_id, xref, size AS orig_size, new_size, new_size < size AS accepted, least(new_size, size) AS kept_size
      FROM images""",
    "stage_plan": f"""WITH {MANIFEST}
      SELECT doc_id, {ENGINE} AS engine, {MODE} AS mode, doc_id % 2 = 0 AS use_lossless, size AS orig_size,
             {STAGES} AS stages FROM manifest""",
    "stage_outcome": f"""WITH {STAGE_REPORTS}
      SELECT doc_id, orig_size, outcome, outcome <> 'failed' AS ok,
             CASE WHEN outcome IN ('failed', 'original_kept') THEN orig_size
                  WHEN outcome IN ('lossy', 'lossy_kept') THEN lossy_size
                  WHEN outcome IN ('gs', 'gs_kept') THEN gs_size ELSE lossless_size END AS out_size FROM outcomes""",
    "output_plan": f"WITH {OUTPUT_PLAN} SELECT * FROM plan",
    "output_plan_repack": f"""WITH {ESTATE},{MEMBER_FILES}
      SELECT rel_path AS output_path, 'file' AS origin, rel_path AS source_path FROM estate WHERE ext IN {COMPRESSIBLE}
      UNION ALL SELECT DISTINCT archive_path, 'repacked_archive', archive_path FROM member_files
                WHERE ext IN {COMPRESSIBLE}""",
    "output_collisions": f"""WITH {OUTPUT_PLAN}
      SELECT output_path, count(*) AS writers, min(source_path) AS first_source FROM plan
      GROUP BY output_path HAVING count(*) > 1""",
    "audit_rows": f"""WITH {RESULTS}
      SELECT '2024-01-02T03:04:05.000600' AS timestamp, rel_path AS input_path, rel_path AS output_path, ext,
             {MIRROR_ACTION} AS action, orig_size, out_size, orig_size - out_size AS saved_bytes,
             printf('%.1f', {_pct("orig_size", "out_size")}) AS saved_pct, '' AS notes FROM results""",
    "archive_paths": f"""WITH {MEMBERS}
      SELECT archive_path, name AS rel_path, 'out/' || {FOLDER} AS folder_output_root,
             'out/' || archive_path AS archive_output_path, archive_path || '::' || name AS audit_input,
             {FOLDER} || '/' || name AS audit_output, 'zip_archive=' || archive_path AS notes FROM members""",
    "relative_paths": f"""WITH {MANIFEST},
      named AS (SELECT doc_id, ext, rel_path, regexp_extract(rel_path, '[^/]+$') AS name FROM manifest)
      SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN name ELSE rel_path END AS below, name,
             CASE WHEN doc_id % 3 = 0 THEN '/other/' ELSE '/data/in/' END || regexp_replace(rel_path, '/[^/]+$', '') AS parent,
             regexp_replace(name, '\\.[^.]+$', '') AS stem, ext FROM named""",
    "overlapping_roots": """WITH roots AS (
        SELECT doc_id, folder AS input_root,
               CASE doc_id % 6 WHEN 0 THEN folder WHEN 1 THEN folder || '/sub' WHEN 2 THEN source
                    WHEN 3 THEN folder || 'x' WHEN 4 THEN '' ELSE folder || '/./a/../' END AS output_root
        FROM (SELECT *, source || '/' || lang AS folder FROM documents)),
      resolved AS (SELECT *, replace(output_root, '/./a/../', '') AS target FROM roots)
      SELECT doc_id, input_root, output_root FROM resolved
      WHERE target <> '' AND (input_root = target OR starts_with(input_root, target || '/')
                              OR starts_with(target, input_root || '/'))""",
    "resize_long_edge": f"""WITH {IMAGES}
      SELECT doc_id, xref, {_resize("new", "edge")} FROM images""",
    "resize_manual": f"""WITH {IMAGES}
      SELECT doc_id, xref, {", ".join(_resize(n, n) for n in ("box", "by_w", "by_h", "free", "down"))} FROM images""",
    "quality_clamps": f"""WITH {TYPED_EVENTS}
      SELECT event_id, typed, q AS quality, greatest(0, q - 20) AS low, q AS high, custom AS custom_dpi,
             custom * 2 AS mono_dpi, CASE WHEN whole IS NOT NULL THEN greatest(36, least(600, whole)) END AS form_dpi
      FROM (SELECT *, greatest(0, least(100, coalesce(whole, 75))) AS q,
                   CASE WHEN whole IS NOT NULL THEN greatest(1, least(2400, whole)) END AS custom FROM parsed)""",
    "form_integers": f"""WITH {TYPED_EVENTS}
      SELECT event_id, typed, CAST(CASE WHEN number > 0 THEN least(65535, trunc(number)) ELSE 0 END AS BIGINT) AS edge
      FROM parsed""",
    "error_cleanup": """
      SELECT doc_id, substr(cleaned, 1, 240) AS error, length(cleaned) AS full_length FROM (
        SELECT doc_id, replace(replace(
                 trim(regexp_replace('  cannot read ' || f || '/in.pdf' || chr(10) || chr(9) || text || ' -> ' || f || '/out.pdf',
                                     '[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]+', ' ', 'g')),
                 f || '/in.pdf', 'in.pdf'), f || '/out.pdf', 'out.pdf') AS cleaned
        FROM (SELECT *, '/tmp/job/' || source AS f FROM documents))""",
    "transparency": f"""WITH {IMAGES}
      SELECT doc_id, xref, CASE WHEN has_alpha THEN min_level < 255 WHEN (doc_id + xref) % 3 = 0 THEN min_level < 255
                                ELSE (doc_id + xref) % 7 = 0 END AS has_transparency FROM images""",
    "event_stamps": """
      SELECT event_id, CASE WHEN event_id % 2 = 0 OR microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS iso,
             strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events""",
    "label_lookup": f"""WITH catalog(lang, key, text) AS (VALUES {LABEL_ROWS}),
      asked AS (SELECT event_id, 'kind.' || event_type AS label_key, {_pick(LANGUAGE_TEXTS, "event_id")} AS lang_text FROM events),
      spoken AS (SELECT *, CASE WHEN lower(trim(lang_text)) IN ('ja', 'ja_jp') THEN 'ja' ELSE 'en' END AS lang FROM asked)
      SELECT event_id, label_key, lang_text, coalesce(l.text, e.text, label_key) AS label, s.lang
      FROM spoken s LEFT JOIN catalog l ON l.key = label_key AND l.lang = s.lang
                    LEFT JOIN catalog e ON e.key = label_key AND e.lang = 'en'""",
    "label_overlay": """WITH local_texts AS (
        SELECT 'order.' || l_orderkey AS key, max(l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY 1),
      base AS (SELECT 'order.' || o_orderkey AS key, o_orderpriority AS text FROM orders)
      SELECT coalesce(l.key, b.key) AS key, coalesce(l.text, b.text) AS text, l.key IS NOT NULL AS is_local
      FROM base b FULL JOIN local_texts l ON l.key = b.key""",
    "template_fill": f"""WITH {RESULTS}
      SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN rel_path || ': ' || orig_size || ' bytes'
             WHEN 1 THEN rel_path || ' (' || printf('%.1f', {_pct("orig_size", "out_size")}) || '%)'
             WHEN 2 THEN '{{name}} {{unknown}}' WHEN 3 THEN 'plain' ELSE '{{name}} {{' END AS text FROM results""",
    "tool_labels": f"""WITH {IMAGES}
      SELECT doc_id, xref, CASE WHEN quantizer = 'pngquant' THEN 'pngquant(' || {_pick(["system", "bundled", "unavailable"], "xref")} || ')'
                                ELSE quantizer END AS tool FROM images""",
    "member_verdicts": f"WITH {VERDICTS} SELECT archive_path, idx, idx_part, idx_supp, name, violation FROM verdicts",
    "archive_quota": f"""WITH {MEMBERS}
      SELECT *, CASE WHEN member_count > {QUOTA.max_members} THEN 'member_count'
                     WHEN total_bytes > {QUOTA.max_bytes} THEN 'total_size' END AS quota_violation
      FROM (SELECT archive_path, count(*) AS member_count, CAST(sum(file_size) AS BIGINT) AS total_bytes
            FROM members GROUP BY archive_path)""",
    "archive_first_violation": f"WITH {FIRST_VIOLATION} SELECT * FROM checked",
    "archive_outcomes": f"""WITH {FIRST_VIOLATION}
      SELECT count(*) FILTER (violation IS NULL) AS extracted, count(*) FILTER (violation IS NOT NULL) AS failed,
             CAST(sum(member_count) FILTER (violation IS NULL) AS BIGINT) AS members_extracted,
             CASE WHEN count(*) = 0 THEN 'none' WHEN count(violation) > 0 THEN 'partial' ELSE 'ok' END AS result
      FROM checked""",
    "repack_candidates": f"""WITH {ARCHIVES},{MEMBER_FILES}
      SELECT * FROM archives WHERE archive_path IN (SELECT archive_path FROM member_files WHERE ext IN {COMPRESSIBLE})""",
    "unprocessed_archives": f"""WITH {ARCHIVES},{MEMBERS}
      SELECT * FROM archives WHERE archive_path NOT IN (SELECT archive_path FROM members)""",
    "image_decisions": f"""WITH {DECISIONS}
      SELECT doc_id, page, seq, slot, xref, rect_w, rect_h, first_use, status,
             {", ".join(f"CASE WHEN first_use THEN {c} END AS {c}" for c in DETAIL)} FROM labelled""",
    "placement_status": f"WITH {DECISIONS} SELECT xref, status, count(*) AS placements FROM labelled GROUP BY xref, status",
    "image_counters": f"""WITH {DECISIONS},
      counted AS (
        SELECT doc_id, count(*) AS image_infos_seen, count(*) FILTER (first_use) AS unique_xrefs_seen,
               count(*) FILTER (status = 'skip_xref_missing') AS skip_xref_missing,
               count(*) FILTER (status LIKE 'skip_already_processed:%') AS skip_already_processed,
               count(*) FILTER (status = 'skip_zero_rect') AS skip_zero_rect,
               count(*) FILTER (status = 'skip_no_extract') AS skip_no_extract,
               count(*) FILTER (status = 'skip_unsupported_ext') AS skip_unsupported_ext,
               count(*) FILTER (status = 'skip_pil_open_failed') AS skip_pil_open_failed,
               count(*) FILTER (status = 'skip_not_smaller') AS skip_not_smaller,
               count(*) FILTER (status = 'replaced') AS replaced
        FROM labelled GROUP BY doc_id),
      opened AS (
        SELECT doc_id, count(*) FILTER (is_cmyk) AS cmyk_converted,
               count(*) FILTER (soft_mask_xref > 0) AS soft_mask_seen,
               count(*) FILTER (soft_mask_xref > 0 AND soft_mask_applied) AS soft_mask_applied,
               count(*) FILTER (soft_mask_xref > 0 AND NOT soft_mask_applied) AS soft_mask_failed,
               count(*) FILTER (output_format = 'PNG' AND quantizer = 'pngquant') AS pngquant_used,
               count(*) FILTER (output_format = 'PNG' AND quantizer <> 'pngquant') AS pillow_png_fallback_used
        FROM decided WHERE opened GROUP BY doc_id)
      SELECT p_partkey AS doc_id, p_size AS pages,
             {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTERS)}
      FROM part LEFT JOIN counted c ON c.doc_id = p_partkey LEFT JOIN opened o ON o.doc_id = p_partkey""",
    "decision_counts": f"""WITH {DECISIONS}
      SELECT doc_id, count(*) AS image_infos_seen, count(*) FILTER (first_use) AS unique_xrefs_seen,
             count(*) FILTER (status LIKE 'skip_already_processed:%') AS skip_already_processed,
             {", ".join(f"count(*) FILTER (status = 'skip_{n}') AS skip_{n}" for n in
                        ("xref_missing", "zero_rect", "no_extract", "unsupported_ext", "pil_open_failed", "not_smaller"))},
             count(*) FILTER (status = 'replaced') AS replaced FROM labelled GROUP BY doc_id""",
    "image_summary": f"""WITH {DECISIONS}
      SELECT doc_id, count(*) AS placements, count(DISTINCT CASE WHEN xref > 0 THEN xref END) AS distinct_images,
             count(*) FILTER (status = 'replaced') AS replaced, count(*) FILTER (status <> 'replaced') AS skipped
      FROM labelled GROUP BY doc_id""",
    "first_use_top50": f"""WITH {DECISIONS}
      SELECT doc_id, page, seq, slot, xref, status, detail_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, seq, slot) AS detail_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page, seq, slot) AS nth FROM labelled)
        WHERE nth = 1) WHERE detail_rank <= 50""",
    "mask_join": f"""WITH {MASKED}
      SELECT doc_id, xref, soft_mask_xref, soft_mask_applied, soft_mask_error, has_transparency FROM masked""",
    "distinct_lists": f"""WITH {DECISIONS}
      SELECT doc_id, string_agg(DISTINCT fallback_reason, ', ' ORDER BY fallback_reason) AS reasons FROM decided
      WHERE output_format = 'PNG' AND fallback_reason IS NOT NULL GROUP BY doc_id""",
    "cleanup_counts": f"""WITH {ESTATE}
      SELECT count(*) FILTER (ext IN ('pdf', 'jpg', 'jpeg', 'png', 'zip')) AS deleted_count,
             count(*) FILTER (ext NOT IN ('pdf', 'jpg', 'jpeg', 'png', 'zip')) AS skipped_count FROM estate""",
    "cleanup_everything": f"WITH {ESTATE} SELECT count(*) AS deleted_count, 0 AS skipped_count FROM estate",
    "cleanup_empty_dirs": f"""WITH {ESTATE},
      pieces AS (SELECT string_split(rel_path, '/') AS parts, ext FROM estate),
      dirs AS (SELECT array_to_string(parts[1:n], '/') AS dir, n AS depth, ext
               FROM (SELECT *, unnest(range(1, len(parts))) AS n FROM pieces))
      SELECT dir, depth FROM dirs GROUP BY dir, depth
      HAVING count(*) FILTER (ext NOT IN ('pdf', 'jpg', 'jpeg', 'png', 'zip')) = 0 ORDER BY depth DESC, dir""",
    "target_counts": f"""WITH {ESTATE}
      SELECT count(*) AS target_files FROM estate WHERE ext IN ('pdf', 'jpg', 'jpeg', 'png', 'csv', 'zip')""",
    "snapshot_select": """WITH listed AS (
        SELECT doc_id AS position, CASE WHEN doc_id % 11 = 0 THEN 'dist/' || doc_id WHEN doc_id % 13 = 0 THEN '  '
               WHEN doc_id % 17 = 0 THEN 'Dist' WHEN doc_id % 19 = 0 THEN 'DIST/' || plain
               WHEN doc_id % 2 = 1 THEN upper(plain) ELSE plain END AS path
        FROM (SELECT *, source || '/' || lang || '/' || (n_chars % 10) || '.txt' AS plain FROM documents))
      SELECT position, path FROM (
        SELECT *, row_number() OVER (PARTITION BY lower(path) ORDER BY position) AS nth FROM listed
        WHERE trim(path) <> '' AND lower(path) <> 'dist' AND path NOT LIKE 'dist/%') WHERE nth = 1""",
    "tree_diff": f"""WITH {RESULTS},
      later AS (SELECT rel_path, out_size AS size FROM results WHERE ext <> 'zip'
                UNION ALL SELECT 'logs/' || conv_id || '-' || turn || '.txt', CAST(strlen(text) AS BIGINT) FROM conversations)
      SELECT coalesce(b.rel_path, a.rel_path) AS rel_path, b.size AS before_size, a.size AS after_size,
             CASE WHEN b.rel_path IS NULL THEN 'added' WHEN a.rel_path IS NULL THEN 'removed' ELSE 'resized' END AS change
      FROM manifest b FULL JOIN later a ON a.rel_path = b.rel_path
      WHERE b.rel_path IS NULL OR a.rel_path IS NULL OR a.size <> b.size""",
    "progress_rank": """
      SELECT *, CAST(trunc(current / total * 100) AS INT) AS pct FROM (
        SELECT user_id AS job_id, event_id AS task_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current,
               count(*) OVER (PARTITION BY user_id) AS total FROM events)""",
    "event_dispatch": f"""WITH {JOB_EVENTS},
      routed AS (
        SELECT *, kind AS target FROM job_events_full WHERE kind IN ('progress', 'stats') OR (kind IN ('log', 'status') AND message IS NOT NULL)
        UNION ALL SELECT *, unnest(['log', 'status']) FROM job_events_full WHERE kind = 'error' AND message IS NOT NULL)
      SELECT job_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                          ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS ts, kind, target,
             CASE WHEN kind = 'error' AND target = 'status' THEN 'status_failed_see_log'
                  WHEN target IN ('log', 'status') THEN message END AS text,
             CASE WHEN target = 'progress' THEN coalesce(current, 0) END AS current,
             CASE WHEN target = 'progress' THEN total END AS total,
             CASE WHEN target = 'progress' THEN CASE WHEN total > 0 THEN CAST(trunc(coalesce(current, 0) / total * 100) AS INT)
                  ELSE 100 END END AS pct,
             CASE WHEN target = 'stats' THEN orig_total END AS orig_total,
             CASE WHEN target = 'stats' THEN out_total END AS out_total,
             CASE WHEN target = 'stats' THEN saved END AS saved,
             CASE WHEN target = 'stats' THEN coalesce(saved_pct, 0) END AS saved_pct
      FROM routed""",
    "job_state": _job_state(),
    "stream_job_state": _job_state(),
    "stream_dedupe": "SELECT DISTINCT 'job/' || user_id || '/' || event_type AS path FROM events",
    "payload_roundtrip": """
      SELECT page_id, CAST(strlen(html) AS BIGINT) AS orig_size, true AS ok, md5(html) AS fingerprint FROM pages""",
    "payload_transform": """
      SELECT page_id, ['txt', 'even', 'bin'][CAST(page_id % 3 AS INT) + 1] AS ext,
             CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN strlen(html) % 2 = 0 END AS ok,
             CASE page_id % 3 WHEN 0 THEN strlen(html) + 1 WHEN 1 THEN CASE WHEN strlen(html) % 2 = 0 THEN strlen(html) END END
               AS out_size,
             CASE WHEN page_id % 3 = 1 AND strlen(html) % 2 = 1 THEN 'ValueError: odd length' END AS error,
             CASE page_id % 3 WHEN 0 THEN md5(html || chr(10)) WHEN 1 THEN CASE WHEN strlen(html) % 2 = 0 THEN md5(html) END END
               AS fingerprint
      FROM pages""",
    "archive_listing": f"""WITH {PACKED_PAGES},
      entries AS (
        SELECT archive_path, rel_path AS name, CAST(strlen(html) AS BIGINT) AS file_size, 1 AS is_file FROM packed
        UNION ALL SELECT DISTINCT archive_path, 'html/', 0, 0 FROM packed
        UNION ALL SELECT DISTINCT archive_path, 'html/' || (page_id % 7) || '/', 0, 0 FROM packed)
      SELECT archive_path, row_number() OVER (PARTITION BY archive_path ORDER BY is_file, name) - 1 AS idx, name, file_size,
             NULL AS error FROM entries""",
    "archive_roundtrip": f"""WITH {PACKED_PAGES}
      SELECT archive_path, rel_path, CAST(strlen(html) AS BIGINT) AS file_size, md5(html) AS fingerprint FROM packed""",
    "archive_from_files": f"""WITH {PACKED_PAGES}
      SELECT archive_path, rel_path, CAST(strlen(html) AS BIGINT) AS file_size, md5(html) AS fingerprint FROM packed""",
    "payload_recompress": """
      SELECT page_id, url AS path, CAST(strlen(html) AS BIGINT) AS orig_size, true AS judged, true AS not_larger, true AS ok, NULL AS error FROM pages""",
    "nested_expansion": f"""
      SELECT 'outer/' || (page_id // {PACK_SIZE} // 5) || '.zip' AS archive_path, 'in/' || (page_id // {PACK_SIZE}) || '/part.zip' AS container,
             'in/' || (page_id // {PACK_SIZE}) || '/html/' || (page_id % 7) || '/' || page_id || '.html' AS rel_path, 1 AS depth,
             md5(html) AS fingerprint FROM pages""",
    "unopened_depth": f"""WITH n AS (SELECT DISTINCT page_id // {PACK_SIZE} AS n FROM pages)
      SELECT 'outer/' || (n // 5) || '.zip' AS archive_path, '' AS container, 0 AS depth,
             CAST(2 * count(*) + 1 AS BIGINT) AS member_count, NULL AS violation FROM n GROUP BY n // 5
      UNION ALL SELECT 'outer/' || (n // 5) || '.zip', 'in/' || n || '/part.zip', 1, 0, 'nesting_limit' FROM n""",
    "damaged_members": f"""
      SELECT 'pages/' || (page_id // {PACK_SIZE}) || '.zip' AS archive_path, 'unreadable_member' AS violation, CAST(1 AS BIGINT) AS unreadable,
             CASE WHEN count(*) > 1 THEN count(*) - 1 END AS readable FROM pages GROUP BY page_id // {PACK_SIZE}""",
    "member_collisions": f"""
      SELECT 'twice/' || (page_id // {PACK_SIZE}) || '.zip' AS archive_path, page_id || '.html' AS rel_path,
             CASE WHEN page_id % 2 = 0 THEN 1 ELSE 0 END AS depth,
             CASE WHEN page_id % 2 = 0 THEN md5(html || '<!-- new -->') ELSE md5(html) END AS fingerprint FROM pages""",
    "folder_roundtrip": """
      SELECT 'p' || (page_id % 10) || '/' || page_id || '.html' AS rel_path, page_id || '.html' AS name, 'html' AS ext,
             CAST(strlen(html) AS BIGINT) AS size, md5(html) AS fingerprint FROM pages""",
    "folder_listing": """
      SELECT CASE WHEN page_id % 3 = 0 THEN '_x' ELSE 'd' END || (page_id % 12) || '/' || name AS rel_path, name, ext, CAST(strlen(html) AS BIGINT) AS size
      FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN '.' ELSE '' END || page_id || ['.html', '.HTM', ''][CAST(page_id % 3 AS INT) + 1] AS name,
                   ['html', 'htm', ''][CAST(page_id % 3 AS INT) + 1] AS ext FROM pages)
      WHERE ext <> '' AND strlen(html) > 1000""",
    "folder_changes": """
      SELECT CASE WHEN page_id % 3 = 0 THEN '_x' ELSE 'd' END || (page_id % 12) || '/' || CASE WHEN page_id % 5 = 0 THEN '.' ELSE '' END || page_id
               || ['.html', '.HTM', ''][CAST(page_id % 3 AS INT) + 1] AS rel_path,
             CAST(strlen(html) AS BIGINT) AS size, md5(html) AS fingerprint FROM pages
      UNION ALL SELECT 'late/' || page_id, CAST(2 * strlen(html) AS BIGINT), md5(html || html) FROM pages WHERE page_id % 4 = 0""",
    "image_headers": """
      SELECT 'p' || (page_id % 7) || '/' || page_id || ['.png', '.JPG', '.jpeg'][kind + 1] AS name, ['png', 'jpg', 'jpeg'][kind + 1] AS ext,
             CAST(CASE WHEN kind = 2 THEN -1 ELSE page_id % 4000 + 1 END AS INT) AS width,
             CAST(CASE WHEN kind = 2 THEN -1 ELSE length(html) % 60000 + 1 END AS INT) AS height,
             CASE kind WHEN 2 THEN -1 WHEN 0 THEN 4 - page_id % 2 ELSE 3 - 2 * (page_id % 2) END AS channels,
             CASE kind WHEN 0 THEN CASE page_id % 2 WHEN 0 THEN 'RGBA' ELSE 'RGB' END WHEN 1 THEN CASE page_id % 2 WHEN 0 THEN 'RGB' ELSE 'L' END END AS mode,
             kind <> 2 AS decodable
      FROM (SELECT *, CAST(page_id % 3 AS INT) AS kind FROM pages)""",
    "output_plan_settings": f"""WITH {ESTATE},{MEMBER_FILES}, plan AS ({_settings_plan()})
      SELECT extract, mirror, repack, origin, count(*) AS paths, count(DISTINCT output_path) AS distinct_paths,
             CAST(sum(length(output_path) + length(source_path)) AS BIGINT) AS letters, min(output_path) AS first_path, max(output_path) AS last_path
      FROM plan GROUP BY extract, mirror, repack, origin""",
    "folder_intake": """
      SELECT page_id || '.html' AS name, 'html' AS ext, CAST(strlen(html) AS BIGINT) AS size, md5(html) AS fingerprint FROM pages""",
    "labels_roundtrip": """
      SELECT 'en' AS lang, 'part_' || p_partkey AS key, p_name AS text FROM part
      UNION ALL SELECT 'ja', 'part_' || p_partkey, p_name FROM part WHERE p_partkey % 3 = 0""",
    "observed_totals": f"""WITH {RESULTS}
      SELECT count(*) AS files_done, CAST(sum(orig_size) AS BIGINT) AS orig_total, CAST(sum(out_size) AS BIGINT) AS out_total FROM results""",
}
ORACLE["audit_roundtrip"] = ORACLE["audit_rows"]
ORACLE["archive_scan"] = ORACLE["archive_listing"]
ORACLE["nested_files"] = ORACLE["nested_expansion"]

_DIFFERENCE = {
    lang: f"""CASE WHEN orig_size > out_size THEN '{saved[0]}' || {_human("abs(orig_size - out_size)")} || '{saved[1]}' || printf('%.1f', {_pct("orig_size", "out_size")}) || '{saved[2]}'
                   WHEN orig_size < out_size THEN ' (increased: ' || {_human("abs(orig_size - out_size)")} || ', +' || printf('%.1f', abs({_pct("orig_size", "out_size")})) || '%)'
                   ELSE '{same}' END"""
    for lang, saved, same in (("en", (" (saved: ", ", -", "%)"), " (no change)"), ("ja", ("、削減 ", " (", "%)"), "、変化なし"))
}
ORACLE["result_messages"] = f"""WITH {RESULTS},
  asked AS (SELECT *, CASE WHEN doc_id % 6 IN (0, 2) THEN 'ja' ELSE 'en' END AS lang FROM results)
  SELECT doc_id, rel_path || ' | ' || CASE lang
      WHEN 'en' THEN 'Before: ' || {_human("orig_size")} || ' -> After: ' || {_human("out_size")} || {_DIFFERENCE["en"]}
      ELSE '前 ' || {_human("orig_size")} || ' 後 ' || {_human("out_size")} || {_DIFFERENCE["ja"]} END AS message FROM asked"""
ORACLE["nested_roots"] = """WITH r AS (
    SELECT DISTINCT CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source || '/' || lang ELSE source || '/' || lang || '/' || (n_chars // 1000) END AS root
    FROM documents)
  SELECT o.root AS outer, i.root AS inner, len(string_split(i.root, '/')) - len(string_split(o.root, '/')) AS levels
  FROM r o JOIN r i ON starts_with(i.root, o.root || '/')"""
ORACLE["live_job_events"] = """
  SELECT 'pages' AS job_id, count(*) AS files_done, CAST(sum(CASE WHEN good THEN strlen(html) ELSE 0 END) AS BIGINT) AS orig_total,
         CAST(sum(CASE WHEN good THEN strlen(html) + CASE page_id % 3 WHEN 0 THEN 1 ELSE 0 END ELSE 0 END) AS BIGINT) AS out_total,
         count(*) FILTER (WHERE page_id % 3 = 1 AND NOT good) AS errors
  FROM (SELECT *, page_id % 3 = 0 OR (page_id % 3 = 1 AND strlen(html) % 2 = 0) AS good FROM pages)"""
ORACLE["tree_diff_folders"] = f"""WITH {MANIFEST},
  later AS (SELECT rel_path, CASE WHEN TRY_CAST(split_part(rel_path, '/', 3) AS BIGINT) % 9 = 0 THEN size + 1 ELSE size END AS size FROM manifest
            UNION ALL SELECT 'logs/' || conv_id || '-' || turn || '.txt', CAST(strlen(text) AS BIGINT) FROM conversations)
  SELECT a.rel_path, b.size AS before_size, a.size AS after_size, CASE WHEN b.rel_path IS NULL THEN 'added' ELSE 'resized' END AS change
  FROM later a LEFT JOIN manifest b ON a.rel_path = b.rel_path WHERE b.rel_path IS NULL OR a.size <> b.size"""
