import pytest

from shrinkwise.operators import routing

EXTS = ["pdf", "jpg", "jpeg", "png", "zip", "txt", ""]


def test_routes(spark):
    df = spark.createDataFrame([(e,) for e in EXTS], "ext string")
    got = {r.ext: (r.handler, r.action_key) for r in routing.route(df).collect()}
    assert got["pdf"] == ("pdf", "csv_action_pdf")
    assert got["jpg"] == got["jpeg"] == ("jpeg", "csv_action_jpeg")
    assert got["png"] == ("png", "csv_action_png")
    assert got["txt"] == got[""] == ("none", "csv_action_failed")


def test_final_actions(spark):
    df = routing.route(spark.createDataFrame([("jpg", True), ("jpg", False), ("txt", False)], "ext string, processed boolean"))
    assert [r.final_action for r in routing.final_action(df, False).collect()] == ["csv_action_jpeg"] + ["csv_action_failed"] * 2
    assert [r.final_action for r in routing.final_action(df, True).collect()] == [
        "csv_action_jpeg", "csv_action_fallback_copy", "csv_action_non_target_copy",
    ]


def test_empty_set_means_nothing_or_everything(spark):
    df = spark.createDataFrame([(e,) for e in EXTS], "ext string")
    assert routing.with_extensions(df, []).count() == 0
    assert routing.cleanup_targets(df, []).count() == len(EXTS)
    assert routing.with_extensions(df, [".PDF", "zip"]).count() == routing.cleanup_targets(df, ["pdf", ".zip"]).count() == 2


def test_stage_plans(spark):
    cases = [
        ("native", "lossy", True, ["lossy"]), ("native", "lossless", False, ["lossless"]),
        ("native", "both", False, ["lossy", "lossless"]), ("native", "strange", True, ["lossy", "lossless"]),
        ("native", None, True, ["lossy", "lossless"]), ("gs", "lossy", False, ["gs"]), ("gs", "both", True, ["gs", "lossless"]),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, engine string, mode string, use_lossless boolean")
    assert [r.stages for r in routing.plan_stages(df).orderBy("i").collect()] == [c[3] for c in cases]


def test_stage_outcomes(spark):
    cases = [
        (["lossy", "lossless"], True, True, None, None, "lossy+lossless", 50),
        (["lossy", "lossless"], True, False, None, None, "lossy_kept", 60),
        (["lossy", "lossless"], False, True, None, None, "lossless_on_original", 50),
        (["lossy", "lossless"], False, False, None, None, "failed", 100),
        (["gs"], None, None, True, None, "original_kept", 100),
        (["gs"], None, None, False, 100, "original_kept", 100),
        (["gs"], None, None, False, 70, "gs", 70),
        (["gs", "lossless"], None, True, False, 70, "gs+lossless", 50),
        (["gs", "lossless"], None, False, False, 70, "gs_kept", 70),
        (["gs", "lossless"], None, True, False, 120, "original+lossless", 50),
        (["gs", "lossless"], None, False, False, 120, "original_kept", 100),
        (["gs", "lossless"], None, True, True, None, "original_kept", 100),
        (["lossy"], True, None, None, None, "lossy", 60),
        (["lossless"], None, False, None, None, "failed", 100),
    ]
    rows = [(i, 100, s, lo, 60, ll, 50, sk, gs) for i, (s, lo, ll, sk, gs, _, _) in enumerate(cases)]
    df = spark.createDataFrame(
        rows,
        "i int, orig_size bigint, stages array<string>, lossy_ok boolean, lossy_size bigint, lossless_ok boolean, "
        "lossless_size bigint, gs_skipped boolean, gs_size bigint",
    )
    got = [(r.outcome, r.out_size) for r in routing.resolve_stages(df).orderBy("i").collect()]
    assert got == [c[-2:] for c in cases]


def test_keep_smaller(spark):
    df = spark.createDataFrame([(10, 9), (10, 10), (10, None)], "orig_size bigint, new_size bigint")
    assert [(r.accepted, r.kept_size) for r in routing.keep_smaller(df).collect()] == [(True, 9), (False, 10), (False, 10)]


TRUTH = {
    (False, False): {"normal.jpg"},
    (False, True): {"normal.jpg", "normal.txt", "subpack/myzip.zip"},
    (True, False, False): {"normal.jpg", "subpack/myzip/img/photo.jpg"},
    (True, False, True): {"normal.jpg", "subpack/myzip.zip"},
    (True, True, False): {
        "normal.jpg", "normal.txt", "subpack/myzip.zip", "subpack/myzip/img/photo.jpg", "subpack/myzip/docs/readme.txt",
    },
    (True, True, True): {"normal.jpg", "normal.txt", "subpack/myzip.zip"},
}


@pytest.mark.parametrize("extract", [False, True])
@pytest.mark.parametrize("mirror", [False, True])
@pytest.mark.parametrize("repack", [False, True])
def test_output_plan_truth_table(spark, extract, mirror, repack):
    manifest = spark.createDataFrame(
        [("normal.jpg", "jpg"), ("normal.txt", "txt"), ("subpack/myzip.zip", "zip")], "rel_path string, ext string"
    )
    members = spark.createDataFrame(
        [("subpack/myzip.zip", "img/photo.jpg", "jpg"), ("subpack/myzip.zip", "docs/readme.txt", "txt")],
        "archive_path string, rel_path string, ext string",
    )
    plan = routing.plan_outputs(manifest, members, extract, mirror, repack)
    key = (extract, mirror, repack) if extract else (extract, mirror)
    assert sorted(r.output_path for r in plan.collect()) == sorted(TRUTH[key])
    assert routing.output_collisions(plan).count() == 0


def test_collisions_are_found(spark):
    plan = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "output_path string, source_path string")
    assert [tuple(r) for r in routing.output_collisions(plan).collect()] == [("a", 2, "x")]


def test_tasks_are_a_union_of_all_three(spark):
    files = spark.createDataFrame([("a", 1)], "rel_path string, size bigint")
    members = spark.createDataFrame([("z.zip", "a", 1)], "archive_path string, rel_path string, size bigint")
    tasks = routing.build_tasks(files, members, files)
    assert sorted(r.origin for r in tasks.collect()) == ["archive_copy", "file", "member"]


def test_several_settings_share_one_plan(spark):
    """Every path is made once, with the settings that write it, and each setting writes what its own plan does."""
    manifest = spark.createDataFrame([("a/x.pdf", "pdf"), ("a/y.txt", "txt"), ("b/z.zip", "zip"), ("b/w.zip", "zip")], "rel_path string, ext string")
    members = spark.createDataFrame(
        [("b/z.zip", "m.jpg", "jpg"), ("b/z.zip", "n.txt", "txt"), ("b/w.zip", "n.txt", "txt"), ("b/w.zip", "q.zip", "zip"), ("b/z.zip", "n.txt", "txt")],
        "archive_path string, rel_path string, ext string",
    )
    settings = [(extract, mirror, repack) for extract in (False, True) for mirror in (False, True) for repack in (False, True)]
    rows = [tuple(r) for r in routing.plan_outputs_each(manifest, members, settings).collect()]
    assert len(rows) == 2 + 2 + 2 + 4
    pdf, txt, copy, member = ("a/x.pdf", "file"), ("a/y.txt", "file"), "archive_copy", "member"
    counts = {s: sorted((r[1], r[2]) for r in rows if r[3] >> i & 1) for i, s in enumerate(settings)}
    assert counts[False, False, False] == counts[False, False, True] == [(pdf[1], pdf[0])]
    assert counts[False, True, True] == [(copy, "b/w.zip"), (copy, "b/z.zip"), (pdf[1], pdf[0]), (txt[1], txt[0])]
    assert counts[True, False, True] == [(pdf[1], pdf[0]), ("repacked_archive", "b/z.zip")]
    assert [o for o, _ in counts[True, True, True]] == ["file", "file", "repacked_archive", "repacked_archive"]
    assert [o for o, _ in counts[True, True, False]] == [copy, copy, "file", "file", *[member] * 4]
    assert [o for o, _ in counts[True, False, False]] == ["file", member]
    for i, setting in enumerate(settings):
        alone = routing.plan_outputs(manifest, members, *setting).collect()
        assert sorted(map(tuple, alone)) == sorted(r[:3] for r in rows if r[3] >> i & 1)
