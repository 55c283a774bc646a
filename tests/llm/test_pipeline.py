"""The pipeline stage by stage, each against a brute-force version on its own input."""

import re

import pytest
from conftest import SF001

import corpus_pipeline
from polysafe.llm import decontam
from test_ngram_join import brute


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, written and read again."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF001).write.parquet(f"{root}/{k}")
        out[name] = docs, (docs := spark.read.parquet(f"{root}/{k}"))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_names_and_columns(stages):
    assert list(stages) == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for before, after in list(stages.values())[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert after.count() == after.select("doc_id").distinct().count() > 0
        assert after.exceptAll(before).isEmpty()


def test_quality_rejects_junk_and_keeps_the_rest(spark, stages):
    before, after = stages["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF001}/labels.parquet").collect()}
    kept = set(texts(after))
    good = [d in kept for d in texts(before) if labels.get(d) == 1]
    junk = [d in kept for d in texts(before) if labels.get(d) == 0]
    assert sum(good) / len(good) > 0.95 and sum(junk) < len(junk) / 2


def test_exact_dedup(stages):
    before, after = map(texts, stages["exact dedup"])
    least = {}
    for d, t in sorted(before.items()):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    assert set(after) == set(least.values())


def test_one_of_each_near_group_stays(stages):
    before, after = map(texts, stages["n-gram Jaccard join"])
    groups = brute(list(before.items()), 5, 80)
    assert set(after) == {d for d, (_, c) in groups.items() if c == d}


def test_benchmark_passages_go(spark, stages):
    before, after = map(texts, stages["benchmark decontamination"])
    def plain(t):
        return " ".join(re.sub(r"[^0-9a-z\x80-\U0010ffff]", " ", t.lower()).split())

    items = [plain(r.text) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    exact = {d for d, t in before.items() if any(i in plain(t) for i in items if len(i) >= decontam.Q)}
    assert exact and not exact & set(after)
    assert set(before) - set(after) == exact


def test_packing_holds_every_document(stages):
    before, after = stages["packing"]
    rows = after.collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == {r.doc_id: r.doc_tokens for r in rows} and set(lengths) == set(texts(before))


def test_run_is_the_stages_in_a_row(spark, stages):
    want = {r.doc_id for r in stages["packing"][1].select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF001).select("doc_id").distinct().collect()} == want


def test_empty_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.collect() == []
