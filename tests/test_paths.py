from pathlib import PurePosixPath

from pyspark.sql import functions as F

from shrinkwise.functions import paths

NAMES = ["a.jpg", ".jpg", "..jpg", "a.", "a..jpg", "A.TAR.GZ", "noext", "...a.jpg", "d.x/noext", "d/e/f.Zip"]


def test_extension_stem_parent(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "p string")
    rows = df.select("p", paths.file_extension("p"), paths.stem("p"), paths.parent_dir("p"), paths.base_name("p")).collect()
    for name, ext, stem, parent, base in rows:
        pure = PurePosixPath(name)
        assert base == pure.name
        assert parent == ("" if str(pure.parent) == "." else str(pure.parent))
        expected = {".jpg": "", "a.": ""}.get(name, pure.suffix.lower().lstrip("."))
        assert ext == expected
        if name not in ("a.", "..jpg", "...a.jpg", "a..jpg"):
            assert stem == pure.stem


def test_extension_table(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES[:8])], "i int, p string").orderBy("i")
    assert [r[0] for r in df.select(paths.file_extension("p")).collect()] == ["jpg", "", "jpg", "", "jpg", "gz", "", "jpg"]


def test_relative_path(spark):
    df = spark.createDataFrame([("/in/a/b.txt",), ("/in",), ("/inner/c.txt",), ("/x/y.z",)], "p string")
    for base in ("/in", "/in/"):
        assert [r[0] for r in df.select(paths.relative_path("p", base)).collect()] == ["a/b.txt", ".", "c.txt", "y.z"]


def test_overlap(spark):
    cases = [
        ("same", "same", True), ("same", "same/child", True), ("same/child", "same", True), ("src1", "src10", False),
        ("", "same", False), ("a", "", False), ("/", "/x", True), ("a/./b/../c", "a/c/d", True), ("/a//b", "/a/b/", True),
        ("a/b", "a/c", False), (None, "a", False),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(paths.paths_overlap("a", "b")).collect()]
    assert got == [c[2] for c in cases]
    assert paths.overlapping_roots(df, "a", "b").count() == sum(got)


def test_archive_plan_and_audit_paths(spark):
    df = spark.createDataFrame(
        [("packs/bundle.zip", "img/photo.jpg"), ("top.ZIP", "x.txt"), ("a/b.c.zip", "y")], "archive_path string, rel_path string"
    )
    rows = paths.audit_paths(paths.archive_plan(df, output_base="out"), repack=True).collect()
    assert [(r.folder_output_root, r.archive_output_path) for r in rows] == [
        ("out/packs/bundle", "out/packs/bundle.zip"), ("out/top", "out/top.zip"), ("out/a/b.c", "out/a/b.c.zip"),
    ]
    assert rows[0].audit_input == "packs/bundle.zip::img/photo.jpg"
    assert rows[0].audit_output == "packs/bundle/img/photo.jpg"
    assert rows[0].notes == "zip_archive=packs/bundle.zip"
    assert paths.audit_paths(df).first().notes == ""


def test_ancestors(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("top.txt",)], "p string")
    assert [r[0] for r in df.select(paths.ancestor_dirs(F.col("p"))).collect()] == [["a", "a/b"], []]
