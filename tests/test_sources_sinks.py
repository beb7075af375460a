import json
from datetime import datetime

import pytest
from conftest import png_bytes, tree_sizes, write_tree, zip_bytes
from pyspark.sql import functions as F

from shrinkwise.operators import payloads
from shrinkwise.sinks import audit
from shrinkwise.sinks.archive_files import pack_archives
from shrinkwise.sinks.payload_files import write_archive_parts, write_payloads
from shrinkwise.sources import scan


@pytest.fixture
def tree(tmp_path):
    write_tree(
        tmp_path,
        {"a.JPG": b"1234", "d/b.txt": b"12", "d/e/z.ZIP": zip_bytes({"m": b"1"}), "d/y.zip": b"x", "p.png": png_bytes(24, 18), "bad.png": b"no"},
    )
    return str(tmp_path)


def test_scans(spark, tree):
    got = {r.rel_path: (r.name, r.ext, r.size) for r in scan.scan_files(spark, tree).collect()}
    assert got == {
        "a.JPG": ("a.JPG", "jpg", 4), "d/b.txt": ("b.txt", "txt", 2), "p.png": ("p.png", "png", len(png_bytes(24, 18))),
        "bad.png": ("bad.png", "png", 2),
    }
    assert {r.rel_path for r in scan.scan_archives(spark, tree, with_content=False).collect()} == {"d/e/z.ZIP", "d/y.zip"}


def test_hidden_names_are_files_too(spark, tmp_path):
    write_tree(tmp_path, {"_x/a.txt": b"1", ".hidden": b"22", "d/_b.ZIP": b"x", "d/.e/f.jpg": b"333"})
    assert {r.rel_path: r.size for r in scan.scan_files(spark, str(tmp_path)).collect()} == {"_x/a.txt": 1, ".hidden": 2, "d/.e/f.jpg": 3}
    assert [r.rel_path for r in scan.scan_archives(spark, f"file:{tmp_path}").collect()] == ["d/_b.ZIP"]


def test_content_is_read_only_on_request(spark, tree, monkeypatch):
    plain = scan.scan_files(spark, tree)
    assert "content" not in plain.columns
    with_bytes = scan.scan_files(spark, tree, with_content=True).where("rel_path = 'd/b.txt'").first()
    assert bytes(with_bytes.content) == b"12" and with_bytes.read_error is None
    gone = scan.read_contents(plain.withColumn("path", F.lit("/nowhere/at/all"))).first()
    assert gone.content is None and "FileNotFoundError" in gone.read_error
    large = scan.read_contents(plain.withColumn("size", F.lit(3_000_000_000).cast("bigint"))).first()
    assert large.content is None and "too large" in large.read_error


def test_rows_without_bytes_are_copied_from_their_source(spark, tree, tmp_path_factory):
    out = tmp_path_factory.mktemp("copies")
    files = scan.scan_files(spark, tree).select("rel_path", "path", F.lit(None).cast("binary").alias("content"))
    assert write_payloads(files, str(out), "rel_path", "content", "path").where("error is not null").count() == 0
    assert tree_sizes(out) == {"a.JPG": 4, "d/b.txt": 2, "p.png": len(png_bytes(24, 18)), "bad.png": 2}


def test_image_headers(spark, tree):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in scan.scan_images(spark, tree).collect()}
    assert (rows["p.png"].width, rows["p.png"].height, rows["p.png"].decodable) == (24, 18, True)
    assert rows["p.png"].mode == "RGB" and rows["bad.png"].width == -1 and not rows["bad.png"].decodable
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08" + (18).to_bytes(2, "big") + (24).to_bytes(2, "big") + b"\x03" + bytes(9)
    assert scan.image_header(jpeg) == (24, 18, 3, "RGB") and scan.image_header(jpeg[:9]) is None and scan.image_header(b"") is None
    assert "a.JPG" in rows and scan.scan_images(spark, tree, drop_invalid=True).count() == 1


def test_a_missing_folder_holds_no_files(spark, tmp_path):
    missing = str(tmp_path / "missing")
    assert scan.scan_files(spark, missing).collect() == [] == scan.scan_archives(spark, missing).collect()


def test_a_broken_label_file_falls_back_to_english(spark, tmp_path):
    (tmp_path / "en.json").write_text('{"a": "A"}')
    (tmp_path / "ja.json").write_text("{")
    assert [tuple(r) for r in scan.read_labels(spark, str(tmp_path)).collect()] == [("en", "a", "A")]


def test_an_unknown_scheme_writes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    df = spark.createDataFrame([("a/b.bin", b"123")], "output_path string, content binary")
    assert "nowhere" in write_payloads(df, "nowhere://host/out").first().error
    assert write_payloads(df, f"file:{tmp_path}/there").first().error is None
    assert tree_sizes(tmp_path) == {"there/a/b.bin": 3}


def test_labels(spark, tmp_path):
    for lang, texts in {"en": {"a": "A", "b.c": "{x}"}, "ja": {"a": "あ"}}.items():
        (tmp_path / f"{lang}.json").write_text(json.dumps(texts, ensure_ascii=False), encoding="utf-8")
    got = sorted(map(tuple, scan.read_labels(spark, str(tmp_path)).collect()))
    assert got == [("en", "a", "A"), ("en", "b.c", "{x}"), ("ja", "a", "あ")]


@pytest.mark.parametrize("body", ['{"a": 1}', '["a"]', '{"a": {"b": "c"}}', "{", '{"a": null}'])
def test_labels_must_be_an_object_of_texts(spark, tmp_path, body):
    (tmp_path / "en.json").write_text(body)
    with pytest.raises(Exception, match="label"):
        scan.read_labels(spark, str(tmp_path)).collect()


def test_audit_round_trip(spark, tmp_path):
    rows = [("in/a,1.jpg", "out/a.jpg", "jpg", "csv_action_jpeg", 200, 100, None), ("z.zip::b", "z/b", "txt", "other", 5, None, 'say "x"')]
    df = spark.createDataFrame(
        rows, "audit_input string, audit_output string, ext string, final_action string, orig_size bigint, out_size bigint, notes string"
    )
    texts = [("en", "csv_action_jpeg", "JPEG compression"), ("en", "csv_header_ext", "type"), ("ja", "csv_header_ext", "種別")]
    catalog = spark.createDataFrame(texts, "lang string, key string, text string")
    headers = audit.audit_headers(catalog, "ja")
    assert headers["ext"] == "種別" and headers["notes"] == "notes" and audit.audit_headers(catalog, "fr")["ext"] == "type"
    out = audit.audit_rows(df, F.lit(datetime(2024, 1, 2, 3, 4, 5)), labels=catalog)
    for fmt in ("csv", "parquet"):
        audit.write_audit(out, str(tmp_path / fmt), fmt, headers=headers)
    back = sorted(map(tuple, scan.read_audit(spark, str(tmp_path / "csv")).collect()))
    assert back == [
        ("2024-01-02T03:04:05", "in/a,1.jpg", "out/a.jpg", "jpg", "JPEG compression", 200, 100, 100, "50.0", ""),
        ("2024-01-02T03:04:05", "z.zip::b", "z/b", "txt", "other", 5, 5, 0, "0.0", 'say "x"'),
    ]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "parquet")).collect())) == back
    assert "already exists" in audit.audit_or_skip(out, str(tmp_path / "csv")).lower()
    assert audit.default_audit_name("20240102_030405") == "compression_log_20240102_030405.csv"


def test_payload_files(spark, tmp_path):
    df = spark.createDataFrame([("a/b.bin", b"123"), ("../escape", b"x"), ("c", None)], "output_path string, content binary")
    got = {r.output_path: (r.bytes_written, r.error) for r in write_payloads(df, str(tmp_path / "out")).collect()}
    assert got["a/b.bin"] == (3, None) and got["c"] == (0, None)
    assert got["../escape"][0] is None and "leaves the output root" in got["../escape"][1]
    assert tree_sizes(tmp_path) == {"out/a/b.bin": 3, "out/c": 0}


def test_archive_parts_are_joined_and_renamed(spark, tmp_path):
    import zipfile

    rows = [("packs/big.zip", f"{i:03}.bin", bytes([i % 251]) * i) for i in range(200)] + [("small.zip", "x", b"1")]
    df = spark.createDataFrame(rows, "archive_path string, rel_path string, content binary")
    write_tree(tmp_path, {"packs/big.zip": b"old" * 100_000})
    written = write_archive_parts(pack_archives(df, part_bytes=2000), str(tmp_path)).collect()
    assert sorted(r.output_path for r in written) == ["packs/big.zip", "small.zip"] and not any(r.error for r in written)
    sizes = {r.archive_path: r.archive_bytes for r in pack_archives(df, part_bytes=2000).collect()}
    assert tree_sizes(tmp_path) == sizes
    with zipfile.ZipFile(tmp_path / "packs/big.zip") as big, zipfile.ZipFile(tmp_path / "small.zip") as small:
        assert big.testzip() is None and len(big.namelist()) == 200 and small.read("x") == b"1"


def test_recompression_keeps_only_smaller_results(spark):
    df = spark.createDataFrame([("t", b"a" * 1000), ("r", bytes(range(20))), ("n", None)], "path string, content binary")
    rows = {r.path: r for r in payloads.recompress_payloads(df).collect()}
    assert rows["t"].accepted and rows["t"].kept_size < 50 and rows["t"].out_content is not None
    assert not rows["r"].accepted and rows["r"].kept_size == 20 and rows["r"].out_content is None
    assert rows["n"].ok is None and not rows["n"].accepted


def test_files_are_read_once_and_originals_pass_through(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], bytes([i]) * i) for i in range(40)], "id int, ext string, content binary")

    def handler(data):
        if len(data) > 30:
            raise ValueError("too long")
        return data[:1]

    done = payloads.transform_payloads(df, {"a": handler}, keep_original=True)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    for r in done.collect():
        shrunk = r.ext == "a" and r.id <= 30
        assert bytes(r.out_content) == bytes([r.id]) * (min(r.id, 1) if shrunk else r.id)
        assert r.ok == ((r.id <= 30) if r.ext == "a" else None) and r.finished_at is not None


def test_one_failing_file_does_not_stop_the_others(spark):
    def handler(data):
        if data == b"boom":
            raise RuntimeError("broken")
        return data[:1]

    df = spark.createDataFrame([(1, "a", b"boom"), (2, "a", b"fine"), (3, "b", b"left")], "id int, ext string, content binary")
    rows = {r.id: (r.ok, r.out_size, r.error) for r in payloads.transform_payloads(df, {"a": handler}).collect()}
    assert rows == {1: (False, None, "RuntimeError: broken"), 2: (True, 1, None), 3: (None, None, None)}
    assert payloads.transform_payloads(df, {"a": handler}, keep_unhandled=False).count() == 2


def test_a_frame_behind_large_segments_is_found(tmp_path):
    from shrinkwise.sources.scan import file_image_header

    frame = b"\xff\xc0\x00\x11\x08" + (30).to_bytes(2, "big") + (40).to_bytes(2, "big") + b"\x03" + bytes(9)
    segment = b"\xff\xe1\xff\xff" + bytes(0xFFFD)
    for n in (0, 1, 20):
        (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + n * segment + frame + b"\xff\xd9")
        assert file_image_header(str(tmp_path / "a.jpg")) == (40, 30, 3, "RGB")
    (tmp_path / "a.jpg").write_bytes(b"\xff\xd8" + 20 * segment)
    assert file_image_header(str(tmp_path / "a.jpg")) is None
