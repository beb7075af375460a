"""ZIP files by ranged reads, work dealt by bytes, and folders as sources."""

import io
import os
import random
import struct
import time
import zipfile
import zlib

import pyarrow as pa
import pytest
from conftest import tree_sizes, write_tree, zip_bytes
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from shrinkwise.config import JobRequest
from shrinkwise.operators.balance import OPEN_BYTES, PIECE_BYTES, by_bytes, payload_slices
from shrinkwise.operators.payloads import transform_payloads
from shrinkwise.plans.job import run_job
from shrinkwise.sources import archive_files, scan
from shrinkwise.sources.archive_files import expand_archives, expanded_members, expanded_verdicts, list_members
from shrinkwise.sources.folder_source import FOLDER_FORMAT, INTAKE_FORMAT, FolderReader, name_ext, register_folder_sources
from shrinkwise.sources.storage import RangedFile, pieces_of
from shrinkwise.sources.zip_directory import PAGE, checked_entries, entries, member_pieces

METHODS = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]


def reader(data, log=None):
    def read_at(offset, length):
        if log is not None:
            log.append(length)
        return data[offset : offset + length]

    return read_at


def contents(data, entry):
    return b"".join(member_pieces(reader(data), **{c: getattr(entry, c) for c in ("offset", "packed_size", "method", "crc", "flags", "file_size")}))


@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 50])
@pytest.mark.parametrize("comment", [b"", b"a comment PK\x05 of the archive" * 20])
def test_members_equal_those_of_the_standard_library(before, comment):
    rng = random.Random(7)
    buffer = io.BytesIO()
    buffer.write(before)
    with zipfile.ZipFile(buffer, "a") as made:
        for i in range(40):
            info = zipfile.ZipInfo(f"d{i % 3}/ü{i}.bin" if i % 2 else f"plain{i}")
            info.external_attr, info.compress_type = i << 16, METHODS[i % 4]
            made.writestr(info, rng.randbytes(rng.choice([0, 10, 5000])) * rng.choice([1, 20]))
        made.comment = comment
    data = buffer.getvalue()
    found = list(entries(reader(data), len(data)))
    with zipfile.ZipFile(io.BytesIO(data)) as opened:
        infos = opened.infolist()
        assert [(e.name, e.file_size, e.external_attr, e.crc) for e in found] == [(i.filename, i.file_size, i.external_attr, i.CRC) for i in infos]
        assert [contents(data, e) for e in found] == [opened.read(i) for i in infos]


def long_form_archive():
    """One stored member whose size, packed size and place are in the long form only, with a long end record."""
    body, name = b"hello", b"a.txt"
    local = struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20)
    local += name + struct.pack("<2H2Q", 1, 16, 5, 5) + body
    extra = struct.pack("<2H3Q", 1, 24, 5, 5, 0)
    entry = struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0, 0, 0, 33, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + extra
    end = struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), len(local))
    end += struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(entry), 1)
    return local + entry + end + struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_the_long_form_is_read():
    data = long_form_archive()
    (entry,) = entries(reader(data), len(data))
    assert (entry.name, entry.file_size, entry.packed_size, entry.offset) == ("a.txt", 5, 5, 0) and contents(data, entry) == b"hello"


def test_damage_is_told_before_the_first_member():
    data = bytearray(zip_bytes({f"f{i}": b"x" * 50 for i in range(20)}))
    data[data.rindex(b"PK\x01\x02")] = 0
    with pytest.raises(zipfile.BadZipFile):
        next(checked_entries(reader(bytes(data)), len(data)))
    for broken in (b"", b"not-a-zip", bytes(data[:-30])):
        with pytest.raises(zipfile.BadZipFile):
            list(entries(reader(broken), len(broken)))


def test_only_the_directory_of_a_large_archive_is_read(spark, tmp_path):
    path = tmp_path / "large.zip"
    directory_at = 3 << 30
    small = zip_bytes({f"m{i}.jpg": b"12345" for i in range(300)})
    at = small.index(b"PK\x01\x02")
    # A sparse file: the members stand at its beginning, the directory behind three gigabytes of nothing.
    with open(path, "wb") as out:
        out.write(small[:at])
        out.seek(directory_at)
        end = bytearray(small[small.rindex(b"PK\x05\x06") :])
        end[16:20] = struct.pack("<I", directory_at)
        out.write(small[at : small.rindex(b"PK\x05\x06")] + end)
    log = []
    with RangedFile(str(path)) as file:
        found = list(entries(lambda o, n: (log.append(n), file.read_at(o, n))[1], file.size))
    assert len(found) == 300 and sum(log) < PAGE and os.path.getsize(path) > 3 << 30
    archives = scan.scan_archives(spark, str(tmp_path), with_content=False)
    rows = list_members(archives, "rel_path", source="path").collect()
    assert len(rows) == 300 and {r.file_size for r in rows} == {5}
    members = expanded_members(expand_archives(archives, path="rel_path", source="path"))
    assert {bytes(r.payload) for r in members.collect()} == {b"12345"}


def test_members_of_one_archive_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_files, "by_bytes", lambda *a: by_bytes(*a, target=4 * OPEN_BYTES))
    write_tree(tmp_path, {"one.zip": zip_bytes({f"m{i}.bin": bytes([i]) * 1000 for i in range(40)})})
    opened = expand_archives(scan.scan_archives(spark, str(tmp_path), with_content=False), path="rel_path", source="path")
    tasks = expanded_members(opened).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in tasks}) >= 8 and sorted(bytes(r.payload)[0] for r in tasks) == list(range(40))


def test_large_inner_archives_and_unwanted_members_pass_by_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive_files, "INLINE_BYTES", 500)
    inner = zip_bytes({"deep/a.jpg": os.urandom(900), "deep/b.txt": b"text"})
    write_tree(tmp_path, {"outer.zip": zip_bytes({"in/inner.zip": inner, "in/small.zip": zip_bytes({"s.jpg": b"s"}), "c.txt": b"c" * 10})})
    archives = scan.scan_archives(spark, str(tmp_path), with_content=False)
    rows = expanded_members(expand_archives(archives, path="rel_path", source="path", exts=["jpg"])).collect()
    got = {r.rel_path: (None if r.payload is None else len(r.payload), r.source is not None) for r in rows}
    assert got == {"in/deep/a.jpg": (900, True), "in/deep/b.txt": (None, True), "in/s.jpg": (1, False), "c.txt": (None, True)}
    assert {r.rel_path: b"".join(pieces_of(r.source)) for r in rows if r.payload is None} == {"in/deep/b.txt": b"text", "c.txt": b"c" * 10}


def test_a_damaged_unwanted_member_is_found(spark, tmp_path):
    blob = bytearray(zip_bytes({"good.txt": b"g" * 20, "bad.txt": b"payload-to-damage"}))
    blob[blob.index(b"bad.txt") + len(b"bad.txt") + 2] ^= 0xFF
    write_tree(tmp_path, {"d.zip": bytes(blob)})
    opened = expand_archives(scan.scan_archives(spark, str(tmp_path), with_content=False), path="rel_path", source="path", exts=["jpg"])
    assert [r.violation for r in expanded_verdicts(opened).collect()] == ["unreadable_member"]
    assert expanded_members(opened).collect()[0].rel_path == "good.txt"


# Work by bytes


def test_partitions_hold_about_the_target(spark):
    rng = random.Random(1)
    sizes = [rng.choice([0, 10, 5_000_000, 40_000_000, None]) for _ in range(800)] + [10**12]
    files = spark.createDataFrame([(f"{i:04}", s, "x") for i, s in enumerate(sizes)], "path string, size bigint, _x string")
    target = 64_000_000
    dealt = by_bytes(files, target=target)
    assert dealt.columns == files.columns
    tasks = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.sum(F.least(F.coalesce("size", F.lit(0)), F.lit(target))).alias("bytes"), F.count("*").alias("n")).collect()
    total = sum(min((s or 0) + OPEN_BYTES, target) for s in sizes)
    assert sum(r.n for r in tasks) == 801 and total // target <= len(tasks) <= total // target + 1
    assert max(r.bytes or 0 for r in tasks) <= 2 * target
    assert by_bytes(files.limit(0)).collect() == []


def test_files_and_handlers_of_a_job_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "by_bytes", lambda *a: by_bytes(*a, target=4 * OPEN_BYTES))
    write_tree(tmp_path / "in", {f"d{i % 5}/{i}.jpg": b"x" * (i * 100) for i in range(60)})
    read = scan.scan_files(spark, str(tmp_path / "in"), with_content=True)
    assert len({r[0] for r in read.select(F.spark_partition_id()).collect()}) >= 15
    report = run_job(spark, JobRequest(str(tmp_path / "in"), str(tmp_path / "out"), audit=False), {"jpg": lambda data: str(os.getpid()).encode()})
    assert report.totals.first().processed_files == 60
    assert len({p.read_bytes() for p in (tmp_path / "out").rglob("*.jpg")}) > 1


# Folders as sources


def test_the_folder_source_lists_and_filters(spark, tmp_path):
    register_folder_sources(spark)
    files = {f"{'_h' if i % 4 == 0 else 'd'}{i % 7}/e/{i}.{('JPG', 'txt', 'tar.gz', '')[i % 4]}": b"x" * i for i in range(50)} | {".top": b"1", "...a": b"2"}
    write_tree(tmp_path, files)
    found = spark.read.format(FOLDER_FORMAT).load(str(tmp_path))
    plain = scan.list_tree(spark, str(tmp_path))
    assert sorted(found.collect()) == sorted(plain.select(found.columns).collect())
    some = found.where((F.col("ext") == "jpg") & (F.col("size") >= 20) & F.col("rel_path").contains("/e/"))
    assert {r.rel_path for r in some.collect()} == {p for p, d in files.items() if p.endswith(".JPG") and len(d) >= 20}
    asked = [EqualTo(("ext",), "jpg"), GreaterThanOrEqual(("size",), 20), EqualTo(("name",), "x"), EqualTo(("size",), None)]
    assert list(FolderReader(str(tmp_path)).pushFilters(asked)) == asked[2:]
    now = spark.sql("select current_timestamp() as t").first().t
    assert found.where(F.col("modified") > F.lit(now)).count() == 0 and found.where(F.col("modified") <= F.lit(now)).count() == len(files)
    assert spark.read.format(FOLDER_FORMAT).load(str(tmp_path / "none")).count() == 0


def test_suffixes_are_those_of_the_column_function(spark):
    names = ["a.jpg", ".jpg", "..jpg", "a.", "a..jpg", "A.TAR.GZ", "noext", "...a.jpg", ".a.B"]
    from shrinkwise.functions.paths import file_extension

    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(file_extension("name")).collect()] == [name_ext(n) for n in names]


def test_a_large_folder_is_shared_by_tasks(spark, tmp_path, monkeypatch):
    from shrinkwise.sources import folder_source

    monkeypatch.setattr(folder_source, "SHARE_FILES", 10)
    monkeypatch.setattr(folder_source, "PLANNED_FOLDERS", 2)
    write_tree(tmp_path, {f"{i}.txt": b"" for i in range(95)} | {f"d/{i}": b"" for i in range(3)} | {"e/f/g": b"", "h/i/j": b""})
    source = folder_source.FolderReader(str(tmp_path))
    work = source.partitions()
    assert sum(w.shares == 10 for w in work) == 10 and sum(w.below for w in work) >= 2
    rows = [name for w in work for batch in source.read(w) for name in batch.column(1).to_pylist()]
    assert sorted(rows) == sorted(tree_sizes(tmp_path)) and len(rows) == 100


def test_the_stream_takes_new_and_changed_files_once(spark, tmp_path):
    register_folder_sources(spark)
    root, out = tmp_path / "in", tmp_path / "out"
    stream = spark.readStream.format(INTAKE_FORMAT).load(str(root)).select("rel_path", "size")

    def take():
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(out)).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(out)).collect())

    write_tree(root, {"a.txt": b"1", "_x/.y": b"22"})
    first = [("_x/.y", 2), ("a.txt", 1)]
    assert take() == first and take() == first
    time.sleep(0.02)
    write_tree(root, {"a.txt": b"changed", "new/b": b"333"})
    both = sorted([*first, ("a.txt", 7), ("new/b", 3)])
    assert take() == both and take() == both


def test_files_too_large_for_a_value_are_rows_with_an_error(spark, tmp_path):
    register_folder_sources(spark)
    with open(tmp_path / "big.bin", "wb") as out:
        out.truncate(3 << 30)
    (tmp_path / "small").write_bytes(b"s")
    rows = {r.rel_path: r for r in scan.read_contents(spark.read.format(FOLDER_FORMAT).load(str(tmp_path))).collect()}
    assert "too large" in rows["big.bin"].read_error and bytes(rows["small"].content) == b"s"


def test_members_are_copied_from_their_place_in_the_archive(spark, tmp_path):
    write_tree(tmp_path / "in", {"z.zip": zip_bytes({"a/t.txt": b"text" * 1000, "p.jpg": b"p" * 10})})
    report = run_job(spark, JobRequest(str(tmp_path / "in"), str(tmp_path / "out"), extract=True, mirror=True, audit=False), {"jpg": lambda d: d[:5]})
    assert report.written.where("error is not null").count() == 0
    assert tree_sizes(tmp_path / "out") == {"z/a/t.txt": 4000, "z/p.jpg": 5, "z.zip": os.path.getsize(tmp_path / "in" / "z.zip")}


def test_workers_make_payloads_slice_by_slice(spark, tmp_path):
    """Of a batch a worker holds the results of a slice: it reports each slice as done, not the whole batch at its end."""
    blobs = [b"x" * (PIECE_BYTES // 4)] * 10 + [None, b""] + [b"y" * (2 * PIECE_BYTES)] + [b"z"]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(blobs))), "content": blobs})
    slices = list(payload_slices(iter([batch, batch.slice(0, 0)]), "content"))
    assert [s.num_rows for s in slices] == [4, 4, 5, 1]
    assert pa.Table.from_batches(slices).to_pydict() == batch.to_pydict()
    content = F.expr(f"cast(repeat('x', {PIECE_BYTES // 4}) as binary)").alias("content")
    rows = spark.range(12, numPartitions=1).select(F.col("id").cast("string").alias("audit_input"), F.lit("a").alias("ext"), content)
    log = str(tmp_path)

    def note(done):
        with open(f"{log}/{time.time_ns()}", "w") as out:
            out.write(str(len(done)))

    assert transform_payloads(rows, {"a": lambda data: data[:3]}, on_done=note).where("ok and out_size = 3").count() == 12
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [4, 4, 4]
