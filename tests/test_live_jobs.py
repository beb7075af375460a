"""Events while a job runs, localised texts, committed sinks, expiring state, and trees and roots compared by folders."""

import os
import random
import sys
import time

import pyarrow as pa
import pytest
from conftest import tree_sizes, write_tree
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shrinkwise.config import JobRequest
from shrinkwise.operators import payloads
from shrinkwise.operators.cleanup import tree_diff
from shrinkwise.operators.folder_digests import changed_folders, folder_digests, tree_diff_by_folders
from shrinkwise.operators.messages import result_messages
from shrinkwise.operators.roots import containing_roots
from shrinkwise.plans.adapters import MESSAGES, job_events, message_catalog
from shrinkwise.plans.job import run_job
from shrinkwise.session import saved_table
from shrinkwise.sinks.committed_files import COMMITTED, StagedFiles, publish_committed, write_committed
from shrinkwise.streaming import monitor
from shrinkwise.streaming.live_events import DoneLog, done_events, once_per_event, read_done, watch_done
from shrinkwise.streaming.seen_paths import SETTINGS, admit_paths

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def shrink(data):
    if data == b"bad":
        raise ValueError("cannot read image")
    return data[: len(data) // 2]


@pytest.fixture
def job_folders(tmp_path):
    write_tree(tmp_path / "in", {f"d{i % 3}/{i}.jpg": b"x" * (100 + i) for i in range(12)} | {"bad.jpg": b"bad", "t.txt": b"text"})
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_events_of_a_running_job_equal_its_totals(spark, job_folders, tmp_path):
    folder, out = str(tmp_path / "events"), str(tmp_path / "state")
    os.makedirs(folder)
    request = JobRequest(*job_folders, mirror=True, audit=False, language="ja")
    report = run_job(spark, request, {"jpg": shrink}, labels=message_catalog(spark), job_id="j1", events_folder=folder)
    totals = report.totals.first()
    state = monitor.job_state(report.events).first()
    assert (state.job_id, state.files_done, state.errors) == ("j1", 14, 1)
    assert (state.orig_total, state.out_total) == (totals.orig_total, totals.out_total)
    texts = {r.message for r in report.events.where("kind in ('log', 'error')").collect()}
    assert "bad.jpg: ValueError: cannot read image" in texts and "d0/0.jpg | 前 100.0B 後 50.0B、削減 50.0B (50.0%)" in texts
    # The same events as a stream, where a repeated attempt counts once.
    DoneLog(folder, "j1")([{**r.asDict()} for r in read_done(spark, folder).limit(5).collect()])
    stream = once_per_event(done_events(watch_done(spark, folder)))
    monitor.publish_state(monitor.job_state(stream), out, str(tmp_path / "progress")).awaitTermination()
    assert monitor.latest_state(spark, out).first() == state


def test_only_attempts_that_count_are_read_with_results(spark, tmp_path):
    folder = str(tmp_path / "events")
    files = spark.createDataFrame([("a", "x", b"1234", 4), ("b", "y", b"5", 1)], "audit_input string, ext string, content binary, orig_size bigint")
    done = payloads.transform_payloads(files, {"x": shrink}, on_done=DoneLog(folder, "j"))
    done.drop("out_content").collect()
    results = saved_table(done.drop("out_content"), "results")
    assert read_done(spark, folder).count() == 4
    rows = {r.task_id: r for r in read_done(spark, folder, results).collect()}
    assert len(rows) == 2 and (rows["a"].ok, rows["a"].out_size, rows["b"].ok) == (True, 2, None)


def slow(data):
    time.sleep(0.3)
    return data


def test_events_come_while_a_task_is_still_at_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(payloads, "REPORT_SECONDS", 0.5)
    files = spark.range(8).coalesce(1).select(F.col("id").cast("string").alias("audit_input"), F.lit("x").alias("ext"), F.lit(b"1").alias("content"))
    payloads.transform_payloads(files, {"x": slow}, on_done=DoneLog(str(tmp_path / "e"), "j")).collect()
    assert len(list((tmp_path / "e").glob("*.parquet"))) >= 3


def test_messages_use_each_language_and_english_where_it_lacks_a_text(spark):
    rows = [(1000, 500, "ja_JP"), (100, 105, "ja"), (7, 7, "ja"), (1000, 500, "fr"), (100, 105, "en"), (5, None, "en"), (0, 0, None)]
    df = spark.createDataFrame(rows, "orig_size bigint, out_size bigint, lang string").withColumn("text", F.lit("x"))
    got = [r.message for r in result_messages(df, message_catalog(spark), F.col("lang")).collect()]
    assert sorted(str(m) for m in got) == sorted(
        [
            "前 1000.0B 後 500.0B、削減 500.0B (50.0%)", "前 100.0B 後 105.0B (increased: 5.0B, +5.0%)", "前 7.0B 後 7.0B、変化なし",
            "Before: 1000.0B -> After: 500.0B (saved: 500.0B, -50.0%)", "Before: 100.0B -> After: 105.0B (increased: 5.0B, +5.0%)", "None",
            "Before: 0.0B -> After: 0.0B (no change)",
        ]
    )
    signed = result_messages(df.where("out_size = 105 and lang = 'en'"), message_catalog(spark), "en", base="text", growth_as_signed=True)
    assert signed.first().message == "x | Before: 100.0B -> After: 105.0B (increased: 5.0B, +-5.0%)"
    none = spark.createDataFrame(MESSAGES, "lang string, key string, text string").limit(0)
    assert result_messages(df.limit(1), none, "en").first().message == "worker_size_before_after"


# Committed files


def test_committed_files_are_all_there(spark, tmp_path):
    out = tmp_path / "out"
    write_tree(tmp_path, {"src.bin": b"s" * 10})
    rows = [("a/1.txt", b"one", None), ("b", None, str(tmp_path / "src.bin")), ("c/empty", None, None)]
    files = spark.createDataFrame(rows, "output_path string, content binary, source string").repartition(3)
    written = write_committed(files, str(out), source="source")
    assert {r.output_path: r.bytes_written for r in written.collect()} == tree_sizes(out) == {"a/1.txt": 3, "b": 10, "c/empty": 0}
    assert write_committed(files.limit(0), str(tmp_path / "none"), source="source").count() == 0


@pytest.mark.parametrize("bad", [("../out.txt", b"x", None), ("z", None, "/nowhere/at/all")])
def test_a_failing_task_leaves_the_target_untouched(spark, tmp_path, bad):
    out = tmp_path / "out"
    write_tree(out, {"old.txt": b"old"})
    rows = [(f"{i}.txt", b"new", None) for i in range(20)] + [("old.txt", b"changed", None), bad]
    files = spark.createDataFrame(rows, "output_path string, content binary, source string").repartition(4)
    with pytest.raises(Exception, match="leaves the output root|No such file|FileNotFoundError"):
        write_committed(files, str(out), source="source")
    assert tree_sizes(out) == {"old.txt": 3}


def test_a_task_that_outlives_an_abort_does_not_bring_the_folder_back(tmp_path):
    staging = tmp_path / ".staging"
    writer = StagedFiles({"root": str(tmp_path), "staging": str(staging)}).writer(None, False)
    row = {"output_path": "a.txt", "content": b"late", "source": None}

    def batches():
        yield pa.RecordBatch.from_pylist([row])
        writer.abort([])
        yield pa.RecordBatch.from_pylist([row])

    for late in (batches(), iter([pa.RecordBatch.from_pylist([row])])):
        with pytest.raises(FileNotFoundError):
            writer.write(late)
        assert not staging.exists()


def test_an_interrupted_move_is_finished_later(spark, tmp_path, monkeypatch):
    out, staging = tmp_path / "out", tmp_path / "out" / ".staging"
    files = spark.createDataFrame([(f"{i}.txt", b"new") for i in range(9)], "output_path string, content binary")
    from shrinkwise.sinks import committed_files

    with monkeypatch.context() as patch:
        patch.setattr(committed_files, "publish_committed", lambda *a: None)
        write_committed(files, str(out), staging=str(staging))
    assert (staging / COMMITTED).exists() and not list(out.glob("*.txt"))
    # What an attempt that does not count has left behind stays out, and a file that was moved already stays.
    write_tree(staging, {"stray/0": b"stray"})
    publish_committed(spark, str(out), str(staging))
    assert tree_sizes(out) == {f"{i}.txt": 3 for i in range(9)}


# State that expires


def arriving(spark, tmp_path, batches):
    folder = tmp_path / "arriving"
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "path string, modified timestamp")
        frame.coalesce(1).write.mode("append").parquet(str(folder))
        for part in folder.glob("part-*"):
            if not part.name.startswith("part-k"):
                part.rename(folder / f"part-k{i}.parquet")
    return spark.readStream.schema("path string, modified timestamp").option("maxFilesPerTrigger", "1").parquet(str(folder))


def admitted(spark, stream, tmp_path, **options):
    out, rows = str(tmp_path / "out"), admit_paths(stream, **options)
    query = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(out)
    assert query.awaitTermination(60)
    for setting in SETTINGS:
        spark.conf.unset(setting)
    return query, spark.read.schema(rows.schema).parquet(out)


def test_changed_files_are_let_in_again(spark, tmp_path):
    from datetime import datetime

    day = lambda n: datetime(2024, 1, n)
    stream = arriving(spark, tmp_path, [[("a", day(1)), ("a", day(2)), ("b", day(1))], [("a", day(2)), ("b", day(3)), (None, day(1))], [("a", day(1)), ("c", None)]])
    query, rows = admitted(spark, stream, tmp_path)
    assert sorted((r.path, r.modified.day) for r in rows.collect()) == [("a", 2), ("b", 1), ("b", 3), ("c", 1)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_state_goes_when_its_time_is_over(spark, tmp_path):
    stream = arriving(spark, tmp_path, [[("a", None), ("b", None)]])
    _, rows = admitted(spark, stream, tmp_path, modified=None, ttl="1 second")
    assert rows.count() == 2
    time.sleep(2)
    arriving(spark, tmp_path, [[], [("a", None)]])
    query, rows = admitted(spark, stream, tmp_path, modified=None, ttl="1 second")
    assert rows.count() == 3
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2


def test_compaction_in_place_loses_nothing(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    table.where("user_id % 5 < 4").repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1").parquet(folder)

    def run():
        monitor.publish_state(monitor.job_state(job_events(stream)), out, str(tmp_path / "progress")).awaitTermination()
        return sorted(map(str, monitor.latest_state(spark, out).collect()))

    before = run()
    monitor.compact_state(spark, out)
    assert len(list((tmp_path / "out").glob("batch=*"))) == 2
    assert sorted(map(str, monitor.latest_state(spark, out).collect())) == before
    table.where("user_id % 5 = 4").coalesce(1).write.mode("append").parquet(folder)
    assert run() == sorted(map(str, monitor.job_state(job_events(table)).collect()))


# Trees and roots


def test_roots_inside_each_other(spark):
    roots = ["/data", "/data/a", "/data/a/", "/data/ab", "data/a/b", "data", "/", "x/./y/../z", "x", "", None, "/data/a/b/c"]
    got = sorted(tuple(r) for r in containing_roots(spark.createDataFrame([(r,) for r in roots], "root string")).collect())
    known = {"/data", "/data/a", "/data/ab", "data/a/b", "data", "/", "x/z", "x", "/data/a/b/c"}
    plain = {(o, i) for o in known for i in known if o != i and i.startswith(o.rstrip("/") + "/")}
    assert {g[:2] for g in got} == plain and len(got) == len(plain)
    assert ("/data", "/data/a/b/c", 3) in got and ("/", "/data", 1) in got and ("x", "x/z", 1) in got


def test_folder_digests_find_what_tree_diff_finds(spark):
    rng = random.Random(4)
    before = {"/".join(rng.choices("abc", k=rng.randint(0, 3)) + [f"f{i}"]): rng.choice([0, 5, None]) for i in range(120)}
    after = dict(before)
    for p in rng.sample(sorted(before), 4):
        after[p] = 77
    for p in rng.sample(sorted(before), 3):
        after.pop(p)
    after |= {"new/deep/x": 1, "top": None}
    frames = [spark.createDataFrame(sorted(t.items()), "rel_path string, size bigint") for t in (before, after)]
    key = lambda r: tuple(map(str, r))
    assert sorted(tree_diff_by_folders(*frames).collect(), key=key) == sorted(tree_diff(*frames).collect(), key=key)
    assert tree_diff_by_folders(frames[0], frames[0]).count() == 0 and tree_diff_by_folders(frames[0].limit(0), frames[0].limit(0)).count() == 0


def test_nothing_below_equal_folders_is_looked_at(spark):
    before = [(f"d{i}/e{j}/f", 1) for i in range(6) for j in range(5)]
    after = [(p, 2 if p == "d3/e2/f" else s) for p, s in before]
    digests = [folder_digests(spark.createDataFrame(t, "rel_path string, size bigint")) for t in (before, after)]
    assert digests[0].count() == 1 + 6 + 30 and digests[0].where("folder = ''").first().below.files == 30
    changed = {(r.folder, r.depth, r.own_differs) for r in changed_folders(*[saved_table(d, "digests") for d in digests]).collect()}
    assert changed == {("", 0, False), ("d3", 1, False), ("d3/e2", 2, True)}


def test_a_path_costs_two_messages_of_its_state_at_most():
    from pyspark.sql import Row

    from shrinkwise.streaming.seen_paths import SeenPaths

    class State:
        calls, value = 0, None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    seen = SeenPaths("path", "changed", 1000)
    seen.seen = state = State()
    rows = [Row(path="a", changed=3), Row(path="a", changed=7)]
    assert list(seen.handleInputRows(("a",), iter(rows), None)) == [Row(path="a", changed=7)]
    assert state.calls == 2
    assert list(seen.handleInputRows(("a",), iter(rows), None)) == []
    assert (state.calls, state.value) == (3, (7,))
