"""The corpus pipeline: what each stage drops or changes, judged on its own input."""

import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from shrinkwise.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_all_but_the_last_return_documents(steps):
    for docs in steps[1:-1]:
        assert docs.dtypes == steps[0].dtypes and 0 < docs.count() <= steps[0].count()


def test_toxic_documents_go(spark, steps):
    low = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SF_DIR).where("predicted = 0").collect()}
    assert set(texts(steps[1])) == low


def test_one_of_equal_texts_stays(steps):
    last = {}
    for i, t in sorted(texts(steps[1]).items()):
        last["".join(c.lower() if "A" <= c <= "Z" else c for c in t)] = i
    assert set(texts(steps[2])) == set(last.values())


def test_repeated_passages_go_and_other_texts_stay(steps):
    before, after = texts(steps[3]), texts(steps[4])
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in before.items()}
    count = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    for i, w in words.items():
        gone = {k for s in range(len(w) - 34) if count[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        assert after[i] == (" ".join(x for k, x in enumerate(w) if k not in gone) if gone else before[i])


def test_every_document_is_packed(steps):
    assert {r.doc_id for r in steps[5].collect()} == set(texts(steps[4]))


def test_run_is_all_stages(spark, steps):
    assert sorted(pipeline.run(spark, SF_DIR).collect()) == sorted(steps[5].collect())
