import io
import random
import struct
import zipfile
import zlib

import pytest
from conftest import zip_bytes
from pyspark.sql import functions as F

from shrinkwise.config import Quota
from shrinkwise.operators import archives
from shrinkwise.sinks import archive_files as sink
from shrinkwise.sinks.archive_files import PART_BYTES, pack_archives
from shrinkwise.sinks.deflated_blocks import moved_crc, source_blocks
from shrinkwise.sources import archive_files
from shrinkwise.sources.archive_files import expand_archives, expanded_members, expanded_verdicts, list_members
from shrinkwise.sources.zip_directory import entries

SYMLINK = 0o120777 << 16
NAMES = [
    "a/b.txt", "../x", "/abs", "C:/x", "..\\x", "a/../b", "\\\\server\\share", "", "./", "..a", "a/..", "x:y", "d/x:y", "./C:/x",
]


def frame(spark, blobs):
    return spark.createDataFrame(list(blobs.items()), "path string, content binary")


VERDICTS = [
    None, "path_traversal", "absolute_path", "drive_path", "path_traversal", "path_traversal", "absolute_path", None, None, None,
    "path_traversal", "drive_path", None, "drive_path",
]


def test_name_verdicts(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "i int, name string").orderBy("i")
    assert [r[0] for r in df.select(archives.name_violation("name")).collect()] == VERDICTS


def test_symlink_beats_name(spark):
    df = spark.createDataFrame(
        [("link", SYMLINK), ("../link", SYMLINK), ("file", 0o100644 << 16)], "name string, external_attr bigint"
    )
    assert [r.violation for r in archives.member_verdict(df).collect()] == ["symlink", "symlink", None]


MEMBERS = "archive_path string, idx int, name string, file_size bigint, external_attr bigint"


def test_first_violations_of_small_archives(spark):
    small = {
        "fine": [("a", 4, 0), ("b", 6, 0)],
        "many": [("a", 1, 0), ("../b", 1, 0), ("c", 1, 0), ("d", 1, 0)],
        "large": [("a", 6, 0), ("b", 5, 0), ("/c", 1, 0)],
        "large and unsafe at once": [("a", 6, 0), ("../b", 5, 0)],
        "unsafe before large": [("a", 6, 0), ("../b", 1, 0), ("c", 9, 0)],
        "link": [("a", 1, 0), ("../b", 1, SYMLINK)],
        "negative sizes": [("a", -9, 0), ("b", 10, 0)],
    }
    rows = [(a, i, *m) for a, members in small.items() for i, m in enumerate(members)]
    checked = archives.first_violation(spark.createDataFrame(rows, MEMBERS), Quota(max_members=3, max_bytes=10)).collect()
    assert {r.archive_path: (r.violation, r.violating_member) for r in checked} == {
        "fine": (None, None), "many": ("member_count", None), "large": ("total_size", "b"), "large and unsafe at once": ("total_size", "../b"),
        "unsafe before large": ("path_traversal", "../b"), "link": ("symlink", "../b"), "negative sizes": (None, None),
    }


def test_first_violation_of_many_archives_whatever_the_limits_and_the_row_order(spark):
    rng = random.Random(11)
    quota = Quota(max_members=12, max_bytes=300)
    rows = [
        (f"a{a}", i, rng.choice(["ok.txt"] * 12 + ["../x", "/x", "C:x"]), rng.randint(-5, 60), rng.choice([0] * 15 + [SYMLINK]))
        for a in range(150)
        for i in range(400 if a == 0 else rng.randint(1, 14))
    ]
    results = []
    for heavy_rows in (2_000_000, 20):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, MEMBERS)
        results.append({r.archive_path: r for r in archives.first_violation(df, quota, heavy_rows=heavy_rows).collect()})
    assert results[0] == results[1] and len(results[0]) == 150
    for r in results[0].values():
        members = {(m[2], m[4]) for m in rows if m[0] == r.archive_path}
        safe = all(name == "ok.txt" and attr == 0 for name, attr in members)
        assert (r.violation is None) == (safe and r.member_count <= 12 and r.total_bytes <= 300)
    outcome = archives.archive_outcomes(archives.first_violation(spark.createDataFrame(rows, MEMBERS), quota)).first()
    assert outcome.extracted + outcome.failed == 150 and outcome.result == "partial"


def test_outcome_classes(spark):
    schema = "archive_path string, member_count bigint, violation string"
    none = archives.archive_outcomes(spark.createDataFrame([], schema)).first()
    assert tuple(none) == (0, 0, 0, "none")
    ok = archives.archive_outcomes(spark.createDataFrame([("a", 3, None)], schema)).first()
    assert tuple(ok) == (1, 0, 3, "ok")


def test_listing(spark):
    blobs = {"good.zip": zip_bytes({"b.txt": b"12", "a/": b"", "a/c.txt": b"3"}), "bad.zip": b"not-a-zip"}
    rows = list_members(frame(spark, blobs)).collect()
    good = [(r.idx, r.name, r.file_size) for r in rows if r.archive_path == "good.zip"]
    assert sorted(good) == [(0, "b.txt", 2), (1, "a/", 0), (2, "a/c.txt", 1)]
    bad = [r for r in rows if r.archive_path == "bad.zip"]
    assert [(r.idx, r.name) for r in bad] == [(-1, None)] and "BadZipFile" in bad[0].error


def test_listing_in_sql(spark):
    archive_files.register_archive_members(spark)
    frame(spark, {"a.zip": zip_bytes({"x": b"1", "y": b"22"})}).createOrReplaceTempView("some_archives")
    rows = spark.sql("SELECT a.path, m.* FROM some_archives a, LATERAL archive_members(a.content) m").collect()
    assert sorted((r.path, r.idx, r.name, r.file_size) for r in rows) == [("a.zip", 0, "x", 1), ("a.zip", 1, "y", 2)]


def outcome_of(spark, blob, **options):
    expanded = expand_archives(frame(spark, {"outer.zip": blob}), **options)
    counts = archives.archive_outcomes(expanded_verdicts(expanded)).first()
    members = {r.rel_path: bytes(r.payload) for r in expanded_members(expanded).collect()}
    reasons = sorted(r.violation for r in expanded_verdicts(expanded).collect() if r.violation)
    return counts.extracted, counts.failed, members, reasons


def test_nested_expansion_lands_beside_the_inner_archive(spark):
    inner = zip_bytes({"nested/photo.jpg": b"img"})
    assert outcome_of(spark, zip_bytes({"inner.zip": inner})) == (2, 0, {"nested/photo.jpg": b"img"}, [])
    assert outcome_of(spark, zip_bytes({"d/Inner.ZIP": inner}))[2] == {"d/nested/photo.jpg": b"img"}


def test_broken_archives(spark):
    assert outcome_of(spark, b"not-a-zip") == (0, 1, {}, ["unreadable"])
    assert outcome_of(spark, zip_bytes({"../../escape.jpg": b"x"})) == (0, 1, {}, ["path_traversal"])
    link = zip_bytes({"link": b"x"}, {"link": SYMLINK})
    assert outcome_of(spark, link) == (0, 1, {}, ["symlink"])
    half = zip_bytes({"ok.txt": b"1", "broken.zip": b"junk", "evil.zip": link})
    assert outcome_of(spark, half) == (1, 2, {"ok.txt": b"1"}, ["symlink", "unreadable"])


def test_quota_and_depth(spark):
    blob = zip_bytes({"a": b"12345", "b": b"12345"})
    assert outcome_of(spark, blob, quota=Quota(1, 100))[3] == ["member_count"]
    assert outcome_of(spark, blob, quota=Quota(5, 9))[3] == ["total_size"]
    assert outcome_of(spark, blob, quota=Quota(2, 10))[:2] == (1, 0)
    deep = zip_bytes({"leaf.txt": b"leaf"})
    for level in range(4):
        deep = zip_bytes({f"l{level}.zip": deep, f"t{level}.txt": b"t"})
    assert outcome_of(spark, deep)[0] == 5
    extracted, failed, members, reasons = outcome_of(spark, deep, max_depth=2)
    assert (extracted, failed, sorted(members), reasons) == (2, 1, ["t2.txt", "t3.txt"], ["nesting_limit"])


def test_the_sum_over_all_levels_is_limited(spark):
    blob = zip_bytes({"in.zip": zip_bytes({"a": b"1" * 400}), "b": b"2"})
    assert outcome_of(spark, blob, quota=Quota(max_total_bytes=300)) == (1, 1, {"b": b"2"}, ["nested_size"])
    assert outcome_of(spark, blob, quota=Quota(max_total_bytes=3000))[:2] == (2, 0)


def test_many_inner_archives_are_reopened_on_demand(spark):
    inner = {f"d{i}/in{i}.zip": zip_bytes({f"x{i}.txt": b"%d" % i, "deep.zip": zip_bytes({f"y{i}.txt": b"y"})}) for i in range(9)}
    extracted, failed, members, _ = outcome_of(spark, zip_bytes(inner))
    assert (extracted, failed) == (19, 0)
    assert members == {f"d{i}/x{i}.txt": b"%d" % i for i in range(9)} | {f"d{i}/y{i}.txt": b"y" for i in range(9)}


def test_a_damaged_member_is_reported_alone(spark):
    blob = bytearray(zip_bytes({"good.txt": b"good", "bad.txt": b"payload-to-damage"}))
    at = blob.index(b"bad.txt") + len(b"bad.txt") + 2
    blob[at] ^= 0xFF
    expanded = expand_archives(frame(spark, {"a.zip": bytes(blob)}))
    rows = {r.rel_path: r for r in expanded.where("kind = 'member'").collect()}
    assert [r.violation for r in expanded_verdicts(expanded).collect()] == ["unreadable_member"]
    assert bytes(rows["good.txt"].payload) == b"good" and rows["good.txt"].error is None
    assert rows["bad.txt"].payload is None and rows["bad.txt"].error


def test_last_writer_wins(spark):
    blob = zip_bytes({"x.txt": b"outer", "in.zip": zip_bytes({"x.txt": b"inner"}), "y.txt": b"y"})
    assert outcome_of(spark, blob)[2] == {"x.txt": b"inner", "y.txt": b"y"}


def packed(spark, rows, **options):
    df = spark.createDataFrame(rows, "archive_path string, rel_path string, content binary")
    parts = pack_archives(df, **options).collect()
    whole = {}
    for p in sorted(parts, key=lambda p: (p.archive_path, p.part)):
        so_far = whole.setdefault(p.archive_path, bytearray())
        assert p.start == len(so_far)
        so_far += p.content
    return parts, {a: zipfile.ZipFile(io.BytesIO(bytes(b))) for a, b in whole.items()}


def test_repack_order_and_count(spark):
    parts, files = packed(spark, [("t.zip", "nested/photo.txt", b"photo"), ("t.zip", "empty/", None)])
    assert files["t.zip"].namelist() == ["empty/", "nested/", "nested/photo.txt"]
    assert [(p.file_count, p.parts) for p in parts] == [(1, 1)]
    assert files["t.zip"].read("nested/photo.txt") == b"photo" and files["t.zip"].testzip() is None


def test_large_archives_come_in_parts_that_join(spark):
    rng = random.Random(2)
    rows = [("big.zip", f"d{i % 5}/ü{i:04}.bin", rng.randbytes(rng.randint(0, 400))) for i in range(300)]
    rows += [(f"s{i}.zip", "one.txt", b"hello") for i in range(20)]
    parts, files = packed(spark, rows, part_bytes=4096)
    big = files["big.zip"]
    assert len([p for p in parts if p.archive_path == "big.zip"]) > 10
    assert max(len(p.content) for p in parts) < 4096 + 600
    assert big.testzip() is None
    assert {i.filename: big.read(i) for i in big.infolist() if not i.is_dir()} == {n: bytes(c) for a, n, c in rows if a == "big.zip"}
    dirs = [n for n in big.namelist() if n.endswith("/")]
    assert big.namelist() == sorted(dirs) + sorted(n for _, n, _ in rows[:300])
    assert all(f.read("one.txt") == b"hello" for a, f in files.items() if a != "big.zip")


def test_small_and_large_archives_are_made_alike(spark):
    names = ["b.txt", "a/ü.txt", "a/c/d.bin", "z/", "a/c/", "a.d/x", "ab", "a-b/y"]
    rows = [("t.zip", n, None if n.endswith("/") else n.encode() * 9) for n in names]
    parts, _ = packed(spark, rows, part_bytes=300)
    (whole,), files = packed(spark, rows)
    assert len(parts) > 1 and b"".join(p.content for p in sorted(parts, key=lambda p: p.part)) == whole.content
    assert (whole.file_count, whole.archive_bytes) == (6, len(whole.content)) == (parts[0].file_count, parts[0].archive_bytes)
    assert files["t.zip"].testzip() is None


def test_more_entries_than_the_short_count_holds(spark):
    df = spark.range(66_000).select(
        F.lit("many.zip").alias("archive_path"),
        F.format_string("%06d", "id").alias("rel_path"),
        F.col("id").cast("string").cast("binary").alias("content"),
    )
    (part,) = pack_archives(df).collect()
    opened = zipfile.ZipFile(io.BytesIO(bytes(part.content)))
    assert part.archive_bytes == len(part.content)
    assert len(opened.namelist()) == 66_000 and opened.read("065999") == b"65999"


def test_far_offsets_use_the_long_form():
    row = {"name": "a.txt", "crc": 1, "packed_size": 2, "raw_size": 3, "far": True, "entry_offset": 5 << 32}
    record = sink._central_entry(row)
    assert len(record) == sink.CENTRAL_HEADER + 5 + sink.OFFSET_EXTRA
    assert record[42:46] == b"\xff\xff\xff\xff" and int.from_bytes(record[-8:], "little") == 5 << 32
    assert sink._end_record(1, len(record), 5 << 32).startswith(b"PK\x06\x06")


@pytest.mark.parametrize("cuts", [[], [0], [1, 5], [3, 3, 900], list(range(1, 4000, 37))])
def test_checksums_of_stretches_make_that_of_the_whole(cuts):
    data = random.Random(3).randbytes(4000)
    edges = [0, *cuts, len(data)]
    whole = 0
    for start, end in zip(edges, edges[1:]):
        whole ^= moved_crc(zlib.crc32(data[start:end]), len(data) - end)
    assert whole == zlib.crc32(data)


def test_checksums_move_over_more_than_four_gigabytes():
    zeros, crc = bytes(1 << 20), zlib.crc32(b"head")
    for _ in range(64):
        crc = zlib.crc32(zeros, crc)
    behind = 64 << 20
    assert moved_crc(zlib.crc32(b"head"), behind) ^ zlib_zeros(behind) == crc
    assert moved_crc(moved_crc(7, 3 << 32), 5) == moved_crc(7, (3 << 32) + 5)


def zlib_zeros(n):
    crc = 0
    for _ in range(n >> 20):
        crc = zlib.crc32(bytes(1 << 20), crc)
    return crc


def test_one_member_is_deflated_by_many_tasks(spark, tmp_path):
    rng = random.Random(4)
    files = {"large.bin": rng.randbytes(300_000), "lines.txt": b"the same line again\n" * 20_000, "empty.bin": b"", "exact.bin": rng.randbytes(8192)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = [("a.zip", f"d/{n}", None, str(tmp_path / n), len(b)) for n, b in files.items()] + [("a.zip", "row.txt", b"in its row" * 900, None, None)]
    df = spark.createDataFrame(rows, "archive_path string, rel_path string, content binary, source string, size bigint")
    files["row.txt"] = b"in its row" * 900
    blocks = source_blocks(df.where("source is not null").withColumnRenamed("rel_path", "name"), 4096, 300_000)
    tasks = blocks.where("name = 'd/large.bin'").select(F.spark_partition_id().alias("task"), "block").collect()
    assert len(tasks) == 74 and len({t.task for t in tasks}) > 10
    made = {}
    for part_bytes in (20_000, PART_BYTES):
        parts = pack_archives(df, source="source", block_bytes=4096, task_bytes=2 << 20, part_bytes=part_bytes).collect()
        made[part_bytes] = b"".join(p.content for p in sorted(parts, key=lambda p: p.part))
        assert part_bytes == PART_BYTES or (len(parts) > 15 and max(len(p.content) for p in parts) < 20_000 + 4200)
    opened = zipfile.ZipFile(io.BytesIO(made[20_000]))
    assert opened.testzip() is None and {n.split("/")[-1]: opened.read(n) for n in opened.namelist() if not n.endswith("/")} == files
    assert made[20_000] == made[PART_BYTES]


def test_a_source_that_became_shorter_makes_no_archive(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"short")
    df = spark.createDataFrame([("a.zip", "x", None, str(tmp_path / "x"), 99)], "archive_path string, rel_path string, content binary, source string, size bigint")
    with pytest.raises(Exception, match="shorter than its 99 bytes"):
        pack_archives(df, source="source")


@pytest.mark.parametrize("far", [False, True])
def test_members_beyond_four_gigabytes_have_long_sizes(far):
    row = {"name": "a", "crc": 1, "packed_size": 6 << 32, "raw_size": 7 << 32, "far": far, "entry_offset": 5 << 32 if far else 9, "packed": None}
    local, central = sink._local_entry(row), sink._central_entry(row)
    assert len(local) == sink.LOCAL_HEADER + 1 + sink.SIZES_EXTRA and local[18:26] == b"\xff" * 8
    assert struct.unpack("<2H2Q", local[-20:]) == (1, 16, 7 << 32, 6 << 32)
    assert len(central) == sink.CENTRAL_HEADER + 1 + (28 if far else 20)
    # Read back by the library's own reader: the entry and its end record, with nothing before them.
    end = sink._end_record(1, len(central), 50 << 32)
    (found,) = entries(lambda at, n: (central + end)[max(at - (50 << 32), 0) :][:n], (50 << 32) + len(central) + len(end))
    assert (found.file_size, found.packed_size, found.offset) == (7 << 32, 6 << 32, row["entry_offset"])


def test_seen_and_repack_selection(spark):
    all_archives = spark.createDataFrame([("a",), ("b",), ("c",)], "archive_path string")
    some = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "archive_path string, n int")
    assert [r[0] for r in archives.unprocessed(all_archives, some).collect()] == ["b"]
    assert sorted(r[0] for r in archives.repack_candidates(all_archives, some).collect()) == ["a", "c"]
