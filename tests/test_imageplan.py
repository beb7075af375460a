import random

import pytest
from pyspark.sql import functions as F

from shrinkwise.operators import imageplan

PLACEMENTS = "doc_id bigint, page int, seq int, xref int, rect_w double, rect_h double"
IMAGES = (
    "doc_id bigint, xref int, ext string, width int, height int, size bigint, has_alpha boolean, smask int, "
    "min_level int, new_size bigint"
)


def decisions(spark, placements, images, **options):
    p = spark.createDataFrame(placements, PLACEMENTS)
    i = spark.createDataFrame(images, IMAGES)
    return imageplan.image_decisions(p, i, **options)


def test_same_image_on_two_pages_is_decided_once(spark):
    rows = decisions(
        spark,
        [(1, 1, 0, 10, 144.0, 72.0), (1, 2, 0, 10, 144.0, 72.0)],
        [(1, 10, "jpeg", 2400, 1200, 9000, False, 0, 255, 400)],
        target_dpi=72,
    ).orderBy("page")
    first, second = rows.collect()
    assert (first.status, first.new_w, first.new_h, first.output_format) == ("replaced", 144, 72, "JPEG")
    assert second.status == "skip_already_processed:replaced" and second.new_w is None
    assert tuple(imageplan.image_summary(rows).first()) == (1, 2, 1, 1, 1)


def test_missing_reference_and_empty_box(spark):
    rows = decisions(spark, [(1, 1, 0, 0, 10.0, 10.0), (1, 1, 1, 11, 0.0, 0.0)], []).orderBy("seq").collect()
    assert [r.status for r in rows] == ["skip_xref_missing", "skip_zero_rect"]


def test_soft_masks(spark):
    images = [
        (1, 20, "jpeg", 100, 100, 900, False, 21, 255, 10), (1, 21, "png", 100, 100, 50, False, 0, 0, 10),
        (1, 30, "jpeg", 100, 100, 900, False, 31, 255, 10), (1, 40, "jpeg", 100, 100, 900, False, 41, 255, 10),
        (1, 41, "png", -1, -1, 50, False, 0, 0, 10), (1, 50, "jpeg", 100, 100, 900, False, 51, 255, 10),
        (1, 51, "png", 100, 100, 50, False, 0, 255, 10),
    ]
    placements = [(1, 1, x, x, 72.0, 72.0) for x in (20, 30, 40, 50)]
    rows = {r.xref: r for r in decisions(spark, placements, images).collect()}
    assert (rows[20].output_format, rows[20].has_transparency, rows[20].soft_mask_applied) == ("PNG", True, True)
    assert (rows[30].output_format, rows[30].soft_mask_error) == ("JPEG", "smask_extract_failed")
    assert rows[40].soft_mask_error == "smask_open_failed" and not rows[40].soft_mask_applied
    assert (rows[50].output_format, rows[50].soft_mask_applied) == ("JPEG", True)


def test_every_status_once(spark):
    images = [
        (1, 1, "jpeg", 50, 40, 100, False, 0, 255, 60), (1, 2, "jpeg", 50, 40, 100, False, 0, 255, 100), (1, 3, "JBIG2", 50, 40, 100, False, 0, 255, 5),
        (1, 4, "png", -1, 40, 100, False, 0, 255, 5), (1, 5, "png", 50, 40, 100, False, 0, 255, None), (1, 6, "png", 50, 40, 100, False, 0, 255, 5),
    ]
    placed = [1, 2, 3, 4, 5, 6, 7, 0, None, -3, 1, 6]
    boxes = {5: (0.0, 9.0), 11: (9.0, 9.0)}  # the first use of image 6 is empty, the second is not
    rows = [(1, 1, i, xref, *boxes.get(i, (10.0, 10.0))) for i, xref in enumerate(placed)]
    got = [r.status for r in decisions(spark, rows, images).orderBy("seq").collect()]
    assert got == [
        "replaced", "skip_not_smaller", "skip_unsupported_ext", "skip_pil_open_failed", "pending", "skip_zero_rect", "skip_no_extract",
        "skip_xref_missing", "skip_xref_missing", "skip_xref_missing", "skip_already_processed:replaced", "skip_already_processed:zero_rect",
    ]


@pytest.fixture(scope="module")
def random_estate():
    rng = random.Random(8)
    images = [
        (d, x, rng.choice(["jpeg", "PNG", "bmp", "jbig2", "JPX", "gif"]), rng.choice([-1, 50, 900]), 400,
         rng.randint(1, 100), rng.random() < 0.3, rng.choice([0, 0, x + 1]), rng.randint(200, 255),
         rng.choice([None, 5, 50, 120]))
        for d in range(12) for x in range(1, 9)
    ]
    placements, position = [], 0
    for _ in range(1500):
        position += 1
        doc = 0 if rng.random() < 0.35 else rng.randrange(12)
        xref = 3 if doc == 0 and rng.random() < 0.9 else rng.choice([None, -1, 0, *range(1, 11)])
        placements.append((doc, rng.randint(1, 9), position, xref, rng.choice([0.0, 5.0, 90.0]), rng.choice([None, 7.0])))
    return placements, images


def test_each_image_is_decided_at_its_first_use_also_with_a_hot_image(spark, random_estate):
    placements, images = random_estate
    first, again = ({(r.doc_id, r.page, r.seq): r for r in decisions(spark, placements, images, heavy_rows=n).collect()} for n in (2_000_000, 25))
    assert {k: r.status for k, r in first.items()} == {k: r.status for k, r in again.items()} and len(first) == len(placements)
    by_image = {}
    for key in sorted(first):
        by_image.setdefault((key[0], first[key].xref), []).append(first[key].status)
    for (_, xref), statuses in by_image.items():
        if xref is None or xref <= 0:
            assert set(statuses) == {"skip_xref_missing"}
        else:
            result = statuses[0].removeprefix("skip_")
            assert not result.startswith("already") and set(statuses[1:]) <= {f"skip_already_processed:{result}"}


def test_counters_agree_with_the_labelled_rows(spark, random_estate):
    placements, images = random_estate
    p, i = spark.createDataFrame(placements, PLACEMENTS), spark.createDataFrame(images, IMAGES)
    direct = {r.doc_id: r.asDict() for r in imageplan.image_counters(p, i).collect()}
    counted = imageplan.count_decisions(imageplan.image_decisions(p, i)).collect()
    assert len(direct) == len(counted) == 12
    for row in counted:
        for name, value in row.asDict().items():
            assert direct[row.doc_id][name] == value


def test_documents_without_images_are_counted_too(spark, random_estate):
    placements, images = random_estate
    p, i = spark.createDataFrame(placements, PLACEMENTS), spark.createDataFrame(images, IMAGES)
    documents = spark.createDataFrame([(d, d + 3) for d in range(14)], "doc_id bigint, pages int")
    rows = {r.doc_id: r for r in imageplan.image_counters(p, i, documents=documents).collect()}
    assert {d: r.pages for d, r in rows.items()} == {d: d + 3 for d in range(14)}
    assert rows[13].image_infos_seen == rows[13].replaced == 0 < rows[0].image_infos_seen


def test_detail_lists_the_first_images_of_each_document(spark, random_estate):
    placements, images = random_estate
    rows = imageplan.first_use_detail(decisions(spark, placements, images), n=4).collect()
    p, i = spark.createDataFrame(placements, PLACEMENTS), spark.createDataFrame(images, IMAGES)
    short = imageplan.first_use_detail(imageplan.first_uses(p, i), n=4, one_per_image=True).collect()
    assert {(r.doc_id, r.seq, r.status) for r in short} == {(r.doc_id, r.seq, r.status) for r in rows}
    expected = set()
    for doc in range(12):
        shown = set()
        for _, page, seq, xref, _, _ in sorted((p for p in placements if p[0] == doc), key=lambda p: (p[1], p[2])):
            if xref not in shown and len(shown) < 4:
                shown.add(xref)
                expected.add((doc, page, seq))
    assert {(r.doc_id, r.page, r.seq) for r in rows} == expected


def test_distinct_list(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "doc_id int, tool string")
    assert [tuple(r) for r in imageplan.distinct_list(df, "tool", by=["doc_id"]).collect()] == [(1, "a, b")]


def test_masks_made_by_an_explode_are_not_broadcast(spark):
    """Estimates do not see what an explode adds: a million masks looked small enough for the driver to gather."""
    objects = spark.range(100_000).select(F.col("id").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(11))).alias("i"))
    images = objects.select(
        "doc_id", F.col("i").cast("bigint").alias("xref"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit(False).alias("has_alpha"),
        F.when(F.col("i") % 3 == 0, F.col("i") + 1).cast("bigint").alias("smask"), F.lit(9).alias("min_level"),
    )
    joined = imageplan.mask_join(images)
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("doc_id < 2 and soft_mask_applied").count() == 6
