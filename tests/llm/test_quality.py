"""Decisions of the language model on labelled documents; the model itself is tested in test_quality_words."""

from conftest import SF01

from polysafe.llm import quality

DOCS = "doc_id long, text string, lang string, kept string, perplexity int, source string"


TEXTS = ["the cat sat on the mat.", "The dog, the cat & 12 mats!", "été là-bas", "a", "the the the the"] * 2 + ["on a mat sat the cat; the end"]


def test_decisions_on_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judge(docs, labels).join(labels, "doc_id").collect()
    good, junk = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(junk) / len(junk) < 0.4


def test_edges(spark):
    rows = [(k, t, "en") for k, t in enumerate(TEXTS)] + [(50, None, "en"), (51, "", None), (52, "§§ŷŷ%%%%####", "xx"), (53, "the cat " * 30_000, None), (None, "the cat", "en"), (1, "the dog", "en")]
    docs = spark.createDataFrame([(*r, "x", 1, "s") for r in rows], DOCS)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(11)] + [(2, 1, 1), (None, 1, 0), (52, 0, None)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels, low=0.0, high=1.0).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert (by_id[50].kept, by_id[51].kept, by_id[50].perplexity) == (False, False, None)
    assert not by_id[52].kept and by_id[0].kept
    assert by_id[52].low == min(r.perplexity for r in got if r.doc_id in range(11))


def test_without_trusted_text_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "x", 1, "s")], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.kept, r.perplexity) for r in quality.judge(docs, labels).collect()] == [(True, None)]
    assert quality.judge(docs.limit(0), labels).collect() == []
