"""The pipeline against its operators applied one by one, and its stages on awkward tables."""

import pytest

import corpus_pipeline
from returnsight.llm import quality, toxicity
from returnsight.llm.secret_scan import find_spans, MIN_GUESS_BITS
from tests.llm.test_simhash import brute_groups, plain_fingerprint

SF001 = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    columns, before = docs.schema, {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF001)
        out.write.parquet(path := str(tmp_path / str(k)))
        docs, given = spark.read.parquet(path), docs
        if name == "best-fit packing":
            break
        assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in columns]
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name == "toxicity":
            want = {r.doc_id for r in toxicity.toxicity_scores(given, labels).collect() if r.predicted == 0}
        elif name == "quality classifier":
            want = {r.doc_id for r in quality.quality_scores(given, labels).collect() if r.predicted == 1}
        elif name == "SimHash near-dedup":
            rows = sorted(before.values(), key=lambda r: r.doc_id)
            label = brute_groups([plain_fingerprint(r.text) for r in rows], 4)
            want = {r.doc_id for k, r in enumerate(rows) if label[k] == k}
        else:
            want = set(before)
            assert all(not find_spans(r.text, MIN_GUESS_BITS)[1] and r.n_chars == len(r.text) for r in after.values() if r.text != before[r.doc_id].text)
        assert set(after) == want and len(want) > 0.5 * len(before)
        if name != "secret scans":
            assert all(after[i] == before[i] for i in want)
        before = after
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(before)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).drop("sequence_id", "offset").collect())) == sorted(tuple(r)[:5] for r in pieces)


@pytest.fixture(scope="module")
def awkward(spark):
    text = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id = 1").first().text
    rows = [(1, text), (2, text), (2, text), (3, None), (4, ""), (5, "x " * 20000), (None, text), (None, None), (7, text + " more")]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s", None, "a", 2, "c", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone_id string, place int, row string, count int")


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_tables(spark, awkward, stage):
    out = stage(spark, awkward, SF001)
    assert stage is corpus_pipeline.pack or out.columns == awkward.columns
    out.collect()
    assert stage(spark, awkward.limit(0), SF001).collect() == []


def test_near_copies_leave_one_row(spark, awkward):
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, awkward, SF001).collect()]
    assert kept.count(2) == 0 and kept.count(1) == 1 and kept.count(None) == 0
    again = awkward.where("doc_id IN (2, 7)")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, again, SF001).collect()] == [2]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    a, b, c, d = (" ".join(f"{k}{i * i % 97}" for i in range(80)) for k in "abcd")
    given = [(5, a), (5, b), (3, b), (6, a + " more"), (7, c), (7, d), (None, "x " + c * 2), (None, "x " + c * 2), (None, "x " + c * 2)]
    label = brute_groups([plain_fingerprint(t) for _, t in given], 4)
    assert label == [0, 1, 1, 0, 4, 5, 6, 6, 6]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
    kept = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, docs, SF001).collect()]
    assert sorted(kept, key=str) == sorted([(5, a), (3, b), (7, c), (7, d), (None, "x " + c * 2)], key=str)


def test_rows_without_an_id_come_last(spark):
    a, b = (" ".join(f"{k}{i * i % 97}" for i in range(80)) for k in "ab")
    docs = spark.createDataFrame([(1, a), (None, a), (None, a + " more"), (None, b), (None, b)], "doc_id long, text string").repartition(3)
    kept = sorted(map(tuple, corpus_pipeline.drop_near_copies(spark, docs, SF001).collect()), key=str)
    assert kept == sorted([(1, a), (None, b)], key=str)


def test_columns_with_dots_and_maps(spark):
    text = "the quick brown fox " * 20
    rows = [(1, text, "en", "s", "p", {"b": 2, "a": 1}), (1, text, "en", "s", "p", {"a": 0}), (None, text, None, None, None, None), (2, "pwd: xK9#mQ2$vL7p", "en", "s", "q", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` string, extra map<string,int>")
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF001)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    masked = corpus_pipeline.mask_secrets(spark, docs, SF001)
    assert masked.columns == docs.columns and {r.text for r in masked.collect()} == {text, "pwd: [secret]"}
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_low_quality):
        assert stage(spark, docs, SF001).columns == docs.columns
