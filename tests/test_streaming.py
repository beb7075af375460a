import pytest
from conftest import write_tree
from pyspark.sql import functions as F

from shrinkwise.plans.adapters import job_events
from shrinkwise.sources.tables import EVENT_SCHEMA
from shrinkwise.streaming import monitor

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def event_stream(spark, tmp_path):
    """The events table cut into files that arrive one per micro-batch."""
    table = spark.read.parquet(EVENTS)
    folder = str(tmp_path / "arriving")
    table.repartition(4).write.parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", "1").parquet(folder)
    return table, stream


def rows(df):
    return sorted(map(str, df.collect()))


def test_running_state_ends_where_the_batch_does(spark, event_stream, tmp_path):
    table, stream = event_stream
    states = monitor.job_state(job_events(stream))
    query = monitor.publish_state(states, str(tmp_path / "out"), str(tmp_path / "progress"))
    query.awaitTermination()
    assert query.lastProgress["batchId"] > 0
    assert rows(monitor.latest_state(spark, str(tmp_path / "out"))) == rows(monitor.job_state(job_events(table)))


def test_paths_are_seen_once_across_batches(spark, event_stream, tmp_path):
    table, stream = event_stream
    named = stream.select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    seen = []

    def collect(frame, _):
        seen.extend(r.path for r in frame.select("path").collect())

    monitor.on_batch(monitor.once_per_path(named, watermark=None), collect, str(tmp_path / "progress")).awaitTermination()
    assert sorted(seen) == sorted(r[0] for r in table.select(F.col("user_id").cast("string")).distinct().collect())
    expiring = monitor.once_per_path(named, watermark="60 days")
    seen.clear()
    monitor.on_batch(expiring, collect, str(tmp_path / "progress2")).awaitTermination()
    assert len(seen) == len(set(seen)) == table.select("user_id").distinct().count()


def test_dispatch_streams_like_it_batches(spark, event_stream, tmp_path):
    table, stream = event_stream
    out = str(tmp_path / "out")
    monitor.on_batch(
        monitor.dispatch_events(job_events(stream)),
        lambda frame, n: frame.write.mode("overwrite").parquet(f"{out}/batch={n}"),
        str(tmp_path / "progress"),
    ).awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch")) == rows(monitor.dispatch_events(job_events(table)))


def test_each_target_gets_its_own_rows(spark, event_stream, tmp_path):
    table, stream = event_stream
    counts = {}

    def counter(target):
        def add(frame, _):
            counts[target] = counts.get(target, 0) + frame.count()

        return add

    callbacks = {t: counter(t) for t in ("log", "progress", "stats")}
    dispatched = monitor.dispatch_events(job_events(stream))
    monitor.on_batch(dispatched, monitor.by_target(callbacks), str(tmp_path / "progress")).awaitTermination()
    expected = monitor.dispatch_events(job_events(table)).where("target <> 'status'").groupBy("target").count()
    assert counts == {r[0]: r[1] for r in expected.collect()}


def test_observed_totals(spark, tmp_path):
    df = spark.createDataFrame([(10, 4), (5, 5)], "orig_size bigint, out_size bigint")
    watched, observation = monitor.observed(df)
    watched.write.parquet(str(tmp_path / "out"))
    assert observation.get == {"files_done": 2, "orig_total": 15, "out_total": 9}


def test_dispatch_rules(spark):
    events = [
        ("j", None, "log", "hi", None, None, None, None, None, None), ("j", None, "log", None, None, None, None, None, None, None),
        ("j", None, "progress", None, 1, None, None, None, None, None), ("j", None, "progress", None, 1, 3, None, None, None, None),
        ("j", None, "stats", None, None, None, 10, None, 4, 40.0), ("j", None, "error", "bad", None, None, None, None, None, None),
        ("j", None, "strange", "x", None, None, None, None, None, None),
    ]
    got = [
        (r.target, r.text, r.current, r.total, r.pct, r.orig_total, r.out_total, r.saved_pct)
        for r in monitor.dispatch_events(spark.createDataFrame(events, EVENT_SCHEMA)).collect()
    ]
    assert got == [
        ("log", "hi", None, None, None, None, None, None), ("progress", None, 1, 0, 100, None, None, None),
        ("progress", None, 1, 3, 33, None, None, None), ("stats", None, None, None, None, 10, 0, 40.0),
        ("log", "bad", None, None, None, None, None, None), ("status", "status_failed_see_log", None, None, None, None, None, None),
    ]


def test_folder_intake_picks_up_only_new_files(spark, tmp_path):
    root, progress = tmp_path / "in", str(tmp_path / "progress")
    write_tree(root, {"a.txt": b"1", "d/b.zip": b"22"})
    seen = []

    def collect(frame, _):
        seen.extend((r.path.rsplit("/", 1)[-1], r.ext, r.size) for r in frame.collect())

    def sweep():
        monitor.on_batch(monitor.watch_folder(spark, str(root)), collect, progress).awaitTermination()

    sweep()
    assert sorted(seen) == [("a.txt", "txt", 1), ("b.zip", "zip", 2)]
    seen.clear()
    sweep()
    assert seen == []
    write_tree(root, {"d/c.ZIP": b"333"})
    sweep()
    assert seen == [("c.ZIP", "zip", 3)]
    archives = monitor.watch_folder(spark, str(root), archives_only=True, files_per_trigger=1)
    seen.clear()
    monitor.on_batch(archives, collect, str(tmp_path / "other")).awaitTermination()
    assert sorted(s[0] for s in seen) == ["b.zip", "c.ZIP"]


def test_a_folder_stream_asks_about_its_files_in_few_tasks(spark, tmp_path):
    write_tree(tmp_path / "in", {f"{k}.txt": b"x" for k in range(60)})
    before, seen = spark.conf.get(monitor.LISTING_TASKS), []
    stream = monitor.watch_folder(spark, str(tmp_path / "in"))
    with monitor.few_listing_tasks(spark):
        query = monitor.on_batch(stream, lambda frame, _: seen.append(frame.count()), str(tmp_path / "progress"))
        query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(str(query.runId))]
    tasks = [tracker.getStageInfo(stage).numTasks for job in jobs for stage in job.stageIds]
    assert seen == [60] and tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(monitor.LISTING_TASKS) == before
