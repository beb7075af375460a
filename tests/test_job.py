"""Whole jobs over real folders, all combinations of the three switches."""

import io
import sys
import zipfile
from datetime import datetime

import pytest
from conftest import png_bytes, tree_sizes, write_tree, zip_bytes
from pyspark import cloudpickle

from shrinkwise.config import JobRequest, ResizeSpec
from shrinkwise.plans.job import CollidingOutputs, OverlappingRoots, archives_to_repack, job_events, run_job
from shrinkwise.sources.scan import read_audit
from shrinkwise.streaming.monitor import dispatch_events, job_state

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shrink(data):
    return data[: len(data) // 2]


def fail(data):
    raise ValueError("cannot read image")


@pytest.fixture
def folders(tmp_path):
    write_tree(
        tmp_path / "input",
        {
            "normal.jpg": b"j" * 100,
            "normal.txt": b"text",
            "subpack/myzip.zip": zip_bytes({"img/photo.jpg": b"p" * 40, "docs/readme.txt": b"readme"}),
        },
    )
    return tmp_path / "input", tmp_path / "output"


def request(folders, **options):
    return JobRequest(str(folders[0]), str(folders[1]), audit=False, **options)


@pytest.mark.parametrize("repack", [False, True])
@pytest.mark.parametrize("mirror", [False, True])
@pytest.mark.parametrize("extract", [False, True])
def test_every_combination(spark, folders, extract, mirror, repack):
    before = tree_sizes(folders[0])
    report = run_job(spark, request(folders, extract=extract, mirror=mirror, repack=repack), {"jpg": shrink})
    assert tree_sizes(folders[0]) == before
    assert report.written.where("error is not null").count() == 0
    out = tree_sizes(folders[1])
    repacked = extract and repack
    assert out["normal.jpg"] == 50
    assert ("normal.txt" in out) == mirror
    assert ("subpack/myzip.zip" in out) == (mirror or repacked)
    assert ("subpack/myzip/img/photo.jpg" in out) == (extract and not repack)
    assert ("subpack/myzip/docs/readme.txt" in out) == (extract and mirror and not repack)
    if "subpack/myzip.zip" in out:
        with zipfile.ZipFile(folders[1] / "subpack/myzip.zip") as archive:
            names = {n for n in archive.namelist() if not n.endswith("/")}
            assert ("docs/readme.txt" in names) == mirror
            assert len(archive.read("img/photo.jpg")) == (20 if repacked else 40)
    totals = report.totals.first()
    assert (totals.processed_files, totals.orig_total, totals.out_total) == ((2, 140, 70) if extract else (1, 100, 50))
    if extract:
        assert tuple(report.archives.first()) == (1, 0, 2, "ok")
        assert [r[0] for r in archives_to_repack(report.results).collect()] == ["subpack/myzip.zip"]


def test_fallback_copy_and_audit(spark, folders):
    spec = JobRequest(str(folders[0]), str(folders[1]), mirror=True, repack=True)
    report = run_job(spark, spec, {"jpg": fail}, started_at=datetime(2024, 1, 2, 3, 4, 5))
    assert tree_sizes(folders[1])["normal.jpg"] == 100
    with zipfile.ZipFile(folders[1] / "subpack/myzip.zip") as archive:
        assert archive.read("img/photo.jpg") == b"p" * 40
    assert tuple(report.totals.first())[:1] == (0,)
    assert report.audit_error is None
    rows = {r.input_path: r for r in read_audit(spark, str(folders[1] / "compression_log_20240102_030405.csv")).collect()}
    assert rows["normal.jpg"].action == "csv_action_fallback_copy"
    assert rows["normal.txt"].action == "csv_action_non_target_copy"
    member = rows["subpack/myzip.zip::img/photo.jpg"]
    assert (member.output_path, member.notes) == ("subpack/myzip/img/photo.jpg", "zip_archive=subpack/myzip.zip")
    assert {r.error for r in report.results.where("ok = false").collect()} == {"ValueError: cannot read image"}


def told(data, settings):
    return repr(sorted(settings.items())).encode()[: len(data) * 10]


def test_handlers_are_told_the_planned_settings(spark, folders):
    write_tree(folders[0], {"a.pdf": b"p" * 300, "b.png": b"q" * 300})
    spec = request(folders, extract=False, jpeg_quality=300, png_quality=40, target_dpi=9000, pdf_mode="lossy", resize=ResizeSpec("long_edge", long_edge=500))
    run_job(spark, spec, {"jpg": told, "pdf": told, "png": told})
    said = {n: (folders[1] / n).read_text() for n in ("normal.jpg", "a.pdf", "b.png")}
    assert "('quality', 100)" in said["normal.jpg"] and "('quality', 40)" in said["b.png"]
    assert "('stages', ['lossy'])" in said["a.pdf"] and "('stages', None)" in said["b.png"]
    assert all("('target_dpi', 2400)" in text and "'long_edge': 500" in text for text in said.values())


def test_archive_copy_is_audited(spark, folders):
    report = run_job(spark, request(folders, extract=False, mirror=True), {"jpg": shrink})
    row = report.audit.where("ext = 'zip'").first()
    size = (folders[0] / "subpack/myzip.zip").stat().st_size
    assert (row.action, row.orig_size, row.out_size, row.saved_pct) == ("csv_action_zip_copy", size, size, "0.0")
    assert row.notes == "zip_archive=subpack/myzip.zip"


def test_empty_input(spark, tmp_path):
    (tmp_path / "input").mkdir()
    report = run_job(spark, request((tmp_path / "input", tmp_path / "output")), {"jpg": shrink})
    assert tuple(report.totals.first()) == (0, 0, 0, 0, 0.0)
    assert report.archives.first().result == "none" and report.results.count() == 0


def test_bad_archives_fail_alone(spark, folders):
    write_tree(folders[0], {"bad.zip": b"not-a-zip", "p/deep.zip": zip_bytes({"in.zip": zip_bytes({"x.png": png_bytes(4, 4)})})})
    report = run_job(spark, request(folders), {"jpg": shrink, "png": shrink})
    assert tuple(report.archives.first())[:2] == (3, 1)
    assert "p/deep/x.png" in tree_sizes(folders[1])


def test_an_unreadable_member_fails_with_an_audit_row(spark, folders):
    blob = bytearray(zip_bytes({"good.jpg": b"g" * 20, "bad.jpg": b"payload-to-damage"}))
    blob[blob.index(b"bad.jpg") + len(b"bad.jpg") + 2] ^= 0xFF
    write_tree(folders[0], {"d.zip": bytes(blob)})
    report = run_job(spark, request(folders, mirror=True), {"jpg": shrink})
    assert tuple(report.archives.first())[:2] == (1, 1) and report.archives.first().result == "partial"
    row = report.results.where("audit_input = 'd.zip::bad.jpg'").first()
    assert row.ok is False and row.error and row.final_action == "csv_action_failed"
    assert {r.input_path for r in report.audit.collect()} >= {"d.zip::bad.jpg", "d.zip::good.jpg"}
    out = tree_sizes(folders[1])
    assert out["d/good.jpg"] == 10 and "d/bad.jpg" not in out


def test_events_of_a_job(spark, folders):
    report = run_job(spark, request(folders, mirror=True), {"jpg": shrink})
    events = job_events(report.results, "j1")
    state = job_state(events).first()
    assert (state.job_id, state.files_done, state.latest_status, state.errors) == ("j1", report.results.count(), "status_complete", 0)
    assert (state.orig_total, state.out_total) == tuple(report.totals.first())[1:3]
    assert dispatch_events(events).where("target = 'progress'").agg({"pct": "max"}).first()[0] == 100


def test_colliding_outputs_stop_the_job(spark, folders):
    write_tree(folders[0], {"subpack/myzip/img/photo.jpg": b"other"})
    with pytest.raises(CollidingOutputs, match="photo.jpg"):
        run_job(spark, request(folders), {"jpg": shrink})


def test_overlapping_folders_stop_the_job(spark, folders):
    with pytest.raises(OverlappingRoots):
        run_job(spark, request((folders[0], folders[0] / "out")), {})


def test_repacked_archive_is_a_plain_zip(spark, folders):
    run_job(spark, request(folders, mirror=True, repack=True), {"jpg": shrink})
    data = (folders[1] / "subpack/myzip.zip").read_bytes()
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == ["docs/", "img/", "docs/readme.txt", "img/photo.jpg"]
