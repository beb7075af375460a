import random
from datetime import datetime, timedelta

import pytest

from shrinkwise.operators import accounting, skew


def test_totals_count_processed_rows_only(spark):
    rows = [("jpg", 100, 60, True), ("jpg", 50, 55, True), ("txt", 999, 999, False), ("png", 0, 0, True), ("pdf", 10, None, True)]
    df = spark.createDataFrame(rows, "ext string, orig_size bigint, out_size bigint, processed boolean")
    assert tuple(accounting.job_totals(df).first()) == (4, 160, 125, 35, 35 / 160 * 100)
    by_ext = {r.ext: r for r in accounting.job_totals(df, by=["ext"]).collect()}
    assert by_ext["png"].saved_pct == 0.0 and by_ext["jpg"].saved == 35 and "txt" not in by_ext


def test_totals_of_nothing(spark):
    df = spark.createDataFrame([], "orig_size bigint, out_size bigint, processed boolean")
    assert tuple(accounting.job_totals(df).first()) == (0, 0, 0, 0, 0.0)


def test_savings_default_to_the_original(spark):
    df = spark.createDataFrame([(10, None), (10, 12)], "orig_size bigint, out_size bigint")
    assert [tuple(r) for r in accounting.with_savings(df).collect()] == [(10, 10, 0, 0.0), (10, 12, -2, -20.0)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_progress_numbers_every_job_whole(spark, kind):
    rng = random.Random(4)
    start = datetime(2024, 3, 31, 0, 30)
    rows = [
        (rng.choice(["hot"] * 5 + ["a", "b", None]), start + timedelta(milliseconds=rng.randint(0, 9_000_000) // 500 * 500), i)
        for i in range(2000)
    ]
    df = spark.createDataFrame(rows, f"job_id string, finished_at {kind}, task_id int")
    got = {(r.job_id, r.task_id): (r.current, r.total, r.pct) for r in accounting.progress(df.repartition(5)).collect()}
    expected = {}
    for job in ("hot", "a", "b", None):
        ordered = sorted((t, i) for j, t, i in rows if j == job)
        for n, (_, task) in enumerate(ordered, 1):
            expected[(job, task)] = (n, len(ordered), int(n / len(ordered) * 100))
    assert got == expected


def test_progress_of_one_instant_null_times_and_null_jobs(spark):
    at = datetime(2024, 1, 1)
    rows = [(None if i % 4 == 0 else "job", None if i % 3 == 0 else at, i) for i in range(60)]
    out = accounting.progress(spark.createDataFrame(rows, "job_id string, finished_at timestamp, task_id int").repartition(6)).collect()
    for job in (None, "job"):
        mine = sorted((r for r in out if r.job_id == job), key=lambda r: r.current)
        assert [r.current for r in mine] == list(range(1, len(mine) + 1)) and {r.total for r in mine} == {len(mine)}
        assert [(r.finished_at is not None, r.task_id) for r in mine] == sorted((r.finished_at is not None, r.task_id) for r in mine)


def test_attach_tasks_with_a_hot_task(spark):
    tasks = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "task_id int, name string")
    results = spark.createDataFrame([(0 if i % 3 else i % 25, i) for i in range(900)], "task_id int, n int")
    got = accounting.attach_tasks(results, tasks, heavy_rows=50)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, results.join(tasks, "task_id").collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_spread_join_equals_a_plain_join(spark, how):
    rng = random.Random(6)
    rows = spark.createDataFrame(
        [(rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choice(["x", "y"]), i) for i in range(1500)], "k int, s string, n int"
    )
    lookup = spark.createDataFrame([(k, s, f"{k}{s}") for k in (1, 2, 3, 9) for s in "xy"], "k int, s string, text string")
    expected = rows.join(lookup, ["k", "s"], how)
    for heavy_rows in (10, 100, 10**6):
        got = skew.spread_join(rows, lookup, ["k", "s"], ["n"], how, heavy_rows)
        assert got.columns == expected.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_running_sums_cross_slices(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, pos int, v int").repartition(7)
    got = {(r.g, r.pos): (r.before, r.again) for r in skew.running_sums(df, ["g"], ["pos"], {"before": "v", "again": "v"}).collect()}
    totals, expected = {}, {}
    for g, pos, v in sorted(rows):
        expected[(g, pos)] = (totals.get(g, 0), totals.get(g, 0))
        totals[g] = totals.get(g, 0) + v
    assert got == expected
