"""Language id: held-out accuracy, and what a prediction may depend on."""

import zlib

from conftest import SF01
from pyspark.sql import functions as F

from polysafe.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, rejected int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) / len(got) < 0.03


ROWS = [(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat", "en"), ("der hund lief um das haus herum", "de"), ("le chat est sur la table", "fr")] * 12)]


def test_edges(spark):
    rows = ROWS + [(100, None, "en"), (101, "", "de"), (102, "123 !?", "en"), (103, "the dog", None), (104, "the dog", None), (105, "le chien " * 40_000, None), (None, "der hund", "de")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for k in (100, 101, 102):
        assert (got[k].lang_pred, got[k].score, got[k].rejected) == ("und", 0.0, True)
    assert [got[k].lang_pred for k in (103, 104, 105, None)] == ["en", "en", "fr", "de"]
    assert not got[None].held_out
    again = langid.predict(docs.drop("lang"), langid.fit(docs.where("lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").withColumnRenamed("doc_id", "id"))).collect()
    assert all(r.lang_pred == got[r.doc_id].lang_pred for r in again)


def test_foreign_text_is_rejected(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS] + [(200, "zzxq qqxz xxzq zqzq", None, "x", 1)], SCHEMA)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert got[200].rejected and got[200].lang_pred in ("en", "de", "fr")


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, "x", 1)], SCHEMA)
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).collect() == []


def test_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame([(k, "ab", "en") for k in range(3_000)], "id long, text string, lang string")
    df, n = langid.document_frequencies(docs)
    assert n == 3_000 and df.max() == 3_000 and set(df) == {0, 3_000}
    assert docs.where(F.col("id") < 0).count() == 0
