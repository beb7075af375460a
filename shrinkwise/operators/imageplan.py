"""Decisions about images placed in documents, as joins and aggregations over metadata.

`placements`: doc_id, page, (order columns), xref, rect_w, rect_h in points (72 per inch).
`images`: doc_id, xref, ext, width, height, size, has_alpha, smask, min_level, new_size; optional
is_cmyk, quantizer, fallback_reason. `min_level` is the darkest sample of an image used as a mask.
`new_size` comes from whatever encoder produced the replacement, null while there is none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shrinkwise.config import DETAIL_ROWS, PNG_LIKE_EXTS, TARGET_DPI, UNSUPPORTED_IMAGE_EXTS
from shrinkwise.functions.scalars import dpi_dims, effective_dpi
from shrinkwise.operators.skew import HEAVY_ROWS, spread_join

KEYS = ["doc_id", "xref"]
XREF_MISSING = "xref_missing"
ORDER = ("page", "seq")
OPTIONAL_IMAGE_COLUMNS = {"is_cmyk": "boolean", "quantizer": "string", "fallback_reason": "string"}
DETAIL_COLUMNS = [
    "ext", "orig_w", "orig_h", "effective_dpi", "resized", "new_w", "new_h", "has_transparency",
    "soft_mask_xref", "soft_mask_applied", "soft_mask_error", "orig_size", "new_size", "output_format",
]


def _valid(placements: DataFrame) -> DataFrame:
    return placements.where(F.col("xref") > 0)


def _missing(placements: DataFrame) -> DataFrame:
    return placements.where(F.coalesce(F.col("xref") <= 0, F.lit(True)))


def _readable(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def mask_join(images: DataFrame, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """Each image with the state of its soft mask.

    Adds soft_mask_xref, soft_mask_applied, soft_mask_error and has_transparency. One join serves all images,
    those without a mask too; a mask shared by very many images does not gather them in one task. The masks are
    all images once more, so they are never broadcast.
    """
    for name, kind in OPTIONAL_IMAGE_COLUMNS.items():
        if name not in images.columns:
            images = images.withColumn(name, F.lit(None).cast(kind))
    own_alpha = F.coalesce(F.col("has_alpha"), F.lit(False))
    wants_mask = F.coalesce(F.col("smask") > 0, F.lit(False))
    masks = images.select(
        "doc_id",
        F.col("xref").alias("_mask"),
        F.lit(True).alias("_found"),
        _readable(F.col("width"), F.col("height")).alias("_opens"),
        F.col("min_level").alias("_level"),
    )
    asked = images.withColumn("_mask", F.when(wants_mask, F.col("smask")))
    joined = spread_join(asked, masks, ["doc_id", "_mask"], ["xref"], "left", heavy_rows, large_lookup=True)
    found, opens = F.coalesce(F.col("_found"), F.lit(False)), F.coalesce(F.col("_opens"), F.lit(False))
    return joined.select(
        *images.columns,
        F.when(wants_mask, F.col("smask")).otherwise(0).cast("bigint").alias("soft_mask_xref"),
        (wants_mask & opens).alias("soft_mask_applied"),
        F.when(wants_mask & ~found, "smask_extract_failed").when(wants_mask & ~opens, "smask_open_failed").alias("soft_mask_error"),
        F.when(wants_mask & opens, F.coalesce(F.col("_level") < 255, F.lit(True))).otherwise(own_alpha).alias("has_transparency"),
    )


def _first_places(placements: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Where each image is first placed, and how often it is placed at all."""
    place = F.struct(*order_by, "rect_w", "rect_h")
    return placements.groupBy(*KEYS).agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("uses"))


def decide_images(
    placements: DataFrame,
    images: DataFrame,
    target_dpi: int = TARGET_DPI,
    order_by: Sequence[str] = ORDER,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per (doc_id, xref) that is a reference: its first use decides for all of them. See _decided."""
    decided = _decided(placements, images, target_dpi, order_by, heavy_rows)
    return decided.where(F.col("result") != XREF_MISSING)


def _decided(
    placements: DataFrame, images: DataFrame, target_dpi: int, order_by: Sequence[str], heavy_rows: int
) -> DataFrame:
    """One row per (doc_id, xref), also where xref is no reference; placements are read once.

    The first use comes from an aggregation (partial minimum before the shuffle), so expensive
    work is planned once per image however often it is placed. `order_by` must be unique in a
    document.
    """
    first = _first_places(placements, order_by)
    described = mask_join(images, heavy_rows).withColumn("_found", F.lit(True))
    joined = first.join(described, KEYS, "left")
    rect_w, rect_h = F.col("_first.rect_w"), F.col("_first.rect_h")
    ext = F.lower(F.coalesce(F.col("ext"), F.lit("")))
    result = (
        F.when(~F.coalesce(F.col("xref") > 0, F.lit(False)), XREF_MISSING)
        .when(~F.coalesce((rect_w > 0) & (rect_h > 0), F.lit(False)), "zero_rect")
        .when(F.col("_found").isNull(), "no_extract")
        .when(ext.isin(*UNSUPPORTED_IMAGE_EXTS), "unsupported_ext")
        .when(~_readable(F.col("width"), F.col("height")), "pil_open_failed")
        .when(F.col("new_size").isNull(), "pending")
        .when(F.col("new_size") < F.col("size"), "replaced")
        .otherwise("not_smaller")
    )
    decided = joined.select(
        *KEYS,
        "uses",
        F.struct(*[F.col(f"_first.{c}").alias(c) for c in order_by]).alias("first_use_at"),
        result.alias("result"),
        rect_w.alias("rect_w"),
        rect_h.alias("rect_h"),
        ext.alias("_ext"),
        *[c for c in described.columns if c not in (*KEYS, "ext", "_found")],
    )
    r = F.col("result")
    decided = decided.withColumns(
        {
            "_extracted": ~r.isin("zero_rect", "no_extract", XREF_MISSING),
            "_opened": r.isin("pending", "replaced", "not_smaller"),
        }
    )
    extracted, opened = F.col("_extracted"), F.col("_opened")
    dpi = effective_dpi("width", "height", "rect_w", "rect_h")
    decided = decided.withColumn("effective_dpi", F.when(opened, dpi))
    as_png = F.col("_ext").isin(*PNG_LIKE_EXTS) | F.col("has_transparency")
    decided = decided.withColumns(
        {"_dims": dpi_dims("width", "height", "effective_dpi", target_dpi), "_png": F.coalesce(opened & as_png, F.lit(False))}
    )

    def when_opened(value: Column) -> Column:
        return F.when(opened, value)

    return decided.select(
        *KEYS,
        "uses",
        "first_use_at",
        "result",
        F.when(extracted, F.col("_ext")).alias("ext"),
        when_opened(F.col("width")).alias("orig_w"),
        when_opened(F.col("height")).alias("orig_h"),
        "effective_dpi",
        when_opened(F.col("_dims.resized")).alias("resized"),
        when_opened(F.col("_dims.new_w")).alias("new_w"),
        when_opened(F.col("_dims.new_h")).alias("new_h"),
        when_opened(F.col("has_transparency")).alias("has_transparency"),
        when_opened(F.col("soft_mask_xref")).alias("soft_mask_xref"),
        when_opened(F.col("soft_mask_applied")).alias("soft_mask_applied"),
        when_opened(F.col("soft_mask_error")).alias("soft_mask_error"),
        F.when(extracted, F.col("size")).alias("orig_size"),
        when_opened(F.col("new_size")).alias("new_size"),
        when_opened(F.when(F.col("_png"), "PNG").otherwise("JPEG")).alias("output_format"),
        when_opened(F.coalesce(F.col("is_cmyk"), F.lit(False))).alias("is_cmyk"),
        F.when(F.col("_png"), F.col("quantizer")).alias("quantizer"),
        F.when(F.col("_png"), F.col("fallback_reason")).alias("fallback_reason"),
    )


def _first_status() -> Column:
    r = F.col("result")
    return F.when(r.isin("replaced", "pending"), r).otherwise(F.concat(F.lit("skip_"), r))


def image_decisions(
    placements: DataFrame,
    images: DataFrame,
    target_dpi: int = TARGET_DPI,
    order_by: Sequence[str] = ORDER,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """One row per placement with its `status`; measurements only on the use that decided.

    Placements without an image reference never enter the join. A picture repeated on very many
    pages is labelled by several tasks (see spread_join).
    """
    decided = decide_images(placements, images, target_dpi, order_by, heavy_rows)
    detail = F.struct(*DETAIL_COLUMNS).alias("detail")
    lookup = decided.select(*KEYS, "first_use_at", "result", detail, F.col("uses").alias("_rows"))
    valid = _valid(placements)
    # Reading `_first` as well keeps this the aggregation of decide_images, so its shuffle is reused.
    counts = _first_places(placements, order_by).where(F.col("_first").isNotNull())
    counts = counts.select(*KEYS, F.col("uses").alias("_rows"))
    rows = spread_join(valid, lookup, KEYS, list(order_by), "left", heavy_rows, counts)
    rows = rows.withColumn("first_use", F.struct(*order_by) == F.col("first_use_at"))
    first = F.col("first_use")
    repeat = F.concat(F.lit("skip_already_processed:"), F.col("result"))
    labelled = rows.select(
        *placements.columns,
        "first_use",
        F.when(first, _first_status()).otherwise(repeat).alias("status"),
        F.when(first, F.col("detail")).alias("detail"),
    ).select(*placements.columns, "first_use", "status", "detail.*")
    missing = _missing(placements).select(
        "*", F.lit(False).alias("first_use"), F.lit("skip_xref_missing").alias("status")
    )
    return labelled.unionByName(missing, allowMissingColumns=True)


# Results of a first use that are reported as skips. Counter names follow from them.
SKIP_RESULTS = ("zero_rect", "no_extract", "unsupported_ext", "pil_open_failed", "not_smaller")


def image_counters(
    placements: DataFrame,
    images: DataFrame,
    order_by: Sequence[str] = ORDER,
    heavy_rows: int = HEAVY_ROWS,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Counters per document, computed from the per-image decisions and their number of uses.

    Repeats are `uses - 1`, so no placement has to be labelled first. `image_infos_seen` and
    `replaced` are at once the document's placement total and its number of changed images.
    `documents` (doc_id, pages) adds the page count and the documents without any image.
    """
    decided = _decided(placements, images, TARGET_DPI, order_by, heavy_rows)
    r = F.col("result")
    missing = r == XREF_MISSING
    masked = F.coalesce(F.col("soft_mask_xref") > 0, F.lit(False))
    png = F.coalesce(F.col("output_format") == "PNG", F.lit(False))
    pngquant = F.coalesce(F.col("quantizer") == "pngquant", F.lit(False))
    per_image = decided.select(
        "doc_id",
        F.col("uses").alias("image_infos_seen"),
        (~missing).cast("int").alias("unique_xrefs_seen"),
        F.when(missing, F.col("uses")).otherwise(0).alias("skip_xref_missing"),
        F.when(missing, 0).otherwise(F.col("uses") - 1).alias("skip_already_processed"),
        *[(r == name).cast("int").alias(f"skip_{name}") for name in SKIP_RESULTS],
        F.coalesce(F.col("is_cmyk"), F.lit(False)).cast("int").alias("cmyk_converted"),
        masked.cast("int").alias("soft_mask_seen"),
        F.coalesce(masked & F.col("soft_mask_applied"), F.lit(False)).cast("int").alias("soft_mask_applied"),
        F.coalesce(masked & ~F.col("soft_mask_applied"), F.lit(False)).cast("int").alias("soft_mask_failed"),
        (png & pngquant).cast("int").alias("pngquant_used"),
        (png & ~pngquant).cast("int").alias("pillow_png_fallback_used"),
        (r == "replaced").cast("int").alias("replaced"),
    )
    counters = per_image.columns[1:]
    counted = per_image
    pages = []
    if documents is not None:
        empty = documents.select("doc_id", "pages", *[F.lit(0).alias(c) for c in counters])
        counted = counted.unionByName(empty, allowMissingColumns=True)
        pages = [F.max("pages").alias("pages")]
    return counted.groupBy("doc_id").agg(*pages, *[F.sum(c).cast("bigint").alias(c) for c in counters])


def count_decisions(decisions: DataFrame) -> DataFrame:
    """The status counters of `image_decisions` output, for decisions produced elsewhere."""
    s = F.col("status")
    names = ("xref_missing", *SKIP_RESULTS)
    return decisions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("image_infos_seen"),
        F.count_if("first_use").alias("unique_xrefs_seen"),
        F.count_if(F.startswith(s, F.lit("skip_already_processed:"))).alias("skip_already_processed"),
        *[F.count_if(s == f"skip_{name}").alias(f"skip_{name}") for name in names],
        F.count_if(s == "replaced").alias("replaced"),
    )


def image_summary(decisions: DataFrame) -> DataFrame:
    """Per document: placements, distinct images, how many were replaced."""
    return decisions.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("placements"),
        F.count_if("first_use").alias("distinct_images"),
        F.count_if(F.col("status") == "replaced").alias("replaced"),
        F.count_if(F.col("status") != "replaced").alias("skipped"),
    )


def distinct_list(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Sorted distinct values joined by ', '. Values are made distinct before they are gathered."""
    values = df.where(F.col(col).isNotNull()).select(*by, col).distinct()
    return values.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(col)), ", ").alias(out or col))


def first_uses(
    placements: DataFrame,
    images: DataFrame,
    target_dpi: int = TARGET_DPI,
    order_by: Sequence[str] = ORDER,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """The rows of `image_decisions` in which an image, or a missing reference, first appears.

    Read from the per-image decisions, so repeats are never labelled or joined.
    """
    decided = _decided(placements, images, target_dpi, order_by, heavy_rows)
    return decided.select(
        "doc_id",
        *[F.col(f"first_use_at.{c}").alias(c) for c in order_by],
        "xref",
        (F.col("result") != XREF_MISSING).alias("first_use"),
        _first_status().alias("status"),
        *DETAIL_COLUMNS,
    )


def first_use_detail(
    decisions: DataFrame, n: int = DETAIL_ROWS, order_by: Sequence[str] = ORDER, one_per_image: bool = False
) -> DataFrame:
    """The first row of each image of a document, the first `n` of those.

    Takes `image_decisions`, or the much smaller `first_uses` with `one_per_image`, which needs no rank per image.
    Ranks are limits Spark applies in every task before the shuffle.
    """
    candidates = decisions
    if not one_per_image:
        candidates = decisions.where(F.col("first_use") | (F.col("status") == f"skip_{XREF_MISSING}"))
        use = F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order_by))
        candidates = candidates.withColumn("_use", use).where(F.col("_use") == 1).drop("_use")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order_by))
    return candidates.withColumn("detail_rank", rank).where(F.col("detail_rank") <= n)
