import json

from shrinkwise.config import INPUT_CLEANUP_EXTS
from shrinkwise.operators import cleanup, labels
from shrinkwise.plans import queries
from shrinkwise.sinks.payload_files import write_payloads


def catalog(spark, rows):
    return spark.createDataFrame(rows, "lang string, key string, text string")


def test_label_falls_back_to_english_then_key(spark):
    texts = catalog(spark, [("en", "a", "A"), ("en", "b", "B"), ("ja", "a", "あ")])
    asked = spark.createDataFrame([("a", "ja_JP"), ("b", "ja"), ("c", "ja"), ("a", "fr"), ("a", None)], "k string, l string")
    assert [r.label for r in labels.label(asked, "k", "l", texts).collect()] == ["あ", "B", "c", "A", "A"]
    split = labels.label(asked, "k", "l", texts, large_catalog=True, heavy_rows=1)
    assert split.columns == ["k", "l", "label"]
    assert sorted(map(str, split.collect())) == sorted(map(str, labels.label(asked, "k", "l", texts).collect()))


def test_overlay(spark):
    base = catalog(spark, [("en", "a", "A"), ("en", "b", "B")])
    local = catalog(spark, [("ja", "a", "あ"), ("ja", "c", "う")])
    assert sorted(map(tuple, labels.overlay(base, local).collect())) == [("a", "あ", True), ("b", "B", False), ("c", "う", True)]


def files(spark, rows):
    return spark.createDataFrame([(p, p.rsplit(".", 1)[-1]) for p in rows], "rel_path string, ext string")


def test_cleanup_plan(spark):
    tree = files(spark, ["packs/bundle.zip", "log.csv", "keep.txt", "a/b/x.pdf", "a/c/y.txt", "deep/er/z.png"])
    plan = cleanup.plan_cleanup(tree, INPUT_CLEANUP_EXTS)
    assert tuple(plan.counts.first()) == (3, 3)
    assert [r.dir for r in plan.emptied_dirs.collect()] == ["a/b", "deep/er", "deep", "packs"]
    everything = cleanup.plan_cleanup(tree)
    assert tuple(everything.counts.first()) == (6, 0)
    assert [r.depth for r in everything.emptied_dirs.collect()] == [2, 2, 2, 1, 1, 1]
    assert cleanup.count_targets(tree, [".csv", ".zip"]).first()[0] == 2
    assert cleanup.count_targets(tree, []).first()[0] == 0


def test_snapshot_keeps_the_first_of_each_path(spark):
    paths = ["b.txt", "dist/x", "", "  ", "B.TXT", "a.txt", "dist", "distant/x", "A.txt"]
    df = spark.createDataFrame(list(enumerate(paths)), "position int, path string")
    assert sorted(map(tuple, cleanup.snapshot_select(df).collect())) == [(0, "b.txt"), (5, "a.txt"), (7, "distant/x")]


def test_tree_diff(spark):
    schema = "rel_path string, size bigint"
    before = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], schema)
    after = spark.createDataFrame([("a", 1), ("b", 5), ("d", 4)], schema)
    got = {r.rel_path: (r.before_size, r.after_size, r.change) for r in cleanup.tree_diff(before, after).collect()}
    assert got == {"b": (2, 5, "resized"), "c": (3, None, "removed"), "d": (None, 4, "added")}
    assert cleanup.tree_diff(before, before).count() == 0
    unknown = spark.createDataFrame([("a", None), ("b", 2), ("gone", None)], schema)
    changed = {r.rel_path: r.change for r in cleanup.tree_diff(unknown, after).collect()}
    assert changed == {"a": "resized", "b": "resized", "gone": "removed", "d": "added"}
    assert cleanup.tree_diff(unknown, unknown).count() == 0


def test_two_texts_for_one_label(spark):
    texts = catalog(spark, [("en", "a", "A"), ("en", "a", "B"), ("ja", "a", "あ")])
    asked = spark.createDataFrame([("a", "en"), ("a", "ja")], "k string, l string")
    assert sorted(r.label for r in labels.label(asked, "k", "l", texts).collect()) == ["B", "あ"]


def test_label_files_do_not_grow_with_the_parts(spark, monkeypatch):
    written = []
    monkeypatch.setattr(queries, "write_payloads", lambda files, root: written.append(files) or write_payloads(files, root))
    rows = queries.labels_roundtrip(spark, "/root/testdata/sf0.01").collect()
    sizes = [len(json.loads(bytes(r.content))) for r in written[0].collect() + [r for w in written[1:] for r in w.collect()]]
    parts = spark.read.parquet("/root/testdata/sf0.01/part.parquet").collect()
    assert max(sizes) <= 1000 and sum(sizes) == len(rows) and len(parts) > 1000
    assert {(r.lang, r.key, r.text) for r in rows} == {(lang, f"part_{p.p_partkey}", p.p_name) for p in parts for lang in ("en", "ja") if lang == "en" or p.p_partkey % 3 == 0}
