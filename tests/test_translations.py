"""The translation store: what is looked up, what is sent to the model, and what moves."""

import hashlib
import re

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polysafe.sources import translations
from polysafe.sources.translations import TranslationStore, text_digest

WANTED = "prompt_id long, text string, language string"


def _models():
    # closures travel to the workers by value
    def translate(texts: pd.Series, language: str) -> pd.Series:
        return texts.map(lambda t: None if t == "untranslatable" else f"{language}:{t}")

    def refuse(texts: pd.Series, language: str) -> pd.Series:
        raise AssertionError(f"asked for {list(texts)} in {language}")

    return translate, refuse


translator, refuse = _models()


def wanted(spark):
    rows = [(k, f"text {k % 7}", ["fr", "de", "es"][k % 3]) for k in range(60)]
    return spark.createDataFrame(rows + [(100, None, "fr"), (101, "x", None), (None, "y", "fr"), (5, "text 5", "es")], WANTED)


def test_translates_each_text_once_and_never_again(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    got = store.translate(wanted(spark), translator, "prompt_id")
    for r in got.collect():
        assert r.translated == (None if r.text is None or r.language is None else f"{r.language}:{r.text}")
    assert got.count() == 64 and store.table().count() == 22
    again = TranslationStore(spark, f"{tmp_path}/store", 4)
    assert again.translate(wanted(spark), refuse, "prompt_id").where("translated is not null").count() == 62


def test_only_the_missing_are_sent(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    store.add(spark.createDataFrame([("text 1", "fr", "kept")], "text string, language string, translated string").withColumn("text_key", text_digest(F.col("text"))))

    translate = translator

    def only_new(texts, language):
        assert not (language == "fr" and "text 1" in list(texts))
        return translate(texts, language)

    got = {(r.text, r.language): r.translated for r in store.translate(wanted(spark), only_new, "prompt_id").collect()}
    assert got["text 1", "fr"] == "kept" and got["text 1", "de"] == "de:text 1"


def test_no_exchange_carries_the_stored_texts(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    store.complete(wanted(spark), translator, "prompt_id")
    for found in (store.lookup(wanted(spark)), store.missing(wanted(spark), "prompt_id")):
        shown = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = re.findall(r"\) (?:Exchange|BroadcastExchange)\nInput \[\d+\]: \[(.*)\]", shown)
        assert moved and not any("translated" in m for m in moved), shown
        assert "SelectedBucketsCount: 4 out of 4" in shown


def test_what_has_no_translation_is_asked_for_again(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    one = spark.createDataFrame([(1, "untranslatable", "fr"), (2, "fine", "fr")], WANTED)
    assert {r.text: r.translated for r in store.translate(one, translator, "prompt_id").collect()} == {"untranslatable": None, "fine": "fr:fine"}
    assert [r.text_key.hex() for r in store.missing(one, "prompt_id").collect()] == [hashlib.sha256(b"untranslatable").hexdigest()]


def test_a_failed_run_leaves_no_trace(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    with pytest.raises(Exception, match="asked for"):
        store.complete(wanted(spark), refuse, "prompt_id")
    assert store.table().count() == 0
    store.complete(wanted(spark), translator, "prompt_id")
    assert store.table().count() == 22


def test_two_writers_of_one_key_give_one_row(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    for said in ("b", "a"):
        store.add(spark.createDataFrame([("t", "fr", said)], "text string, language string, translated string").withColumn("text_key", text_digest(F.col("text"))))
    got = store.lookup(spark.createDataFrame([(1, "t", "fr")], WANTED)).collect()
    assert [r.translated for r in got] == ["a"]


def test_buckets_are_fixed_and_empty_requests_are_fine(spark, tmp_path):
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    none = spark.createDataFrame([], WANTED)
    assert store.translate(none, refuse, "prompt_id").collect() == []
    store.complete(wanted(spark), translator, "prompt_id")
    with pytest.raises(ValueError):
        TranslationStore(spark, f"{tmp_path}/store", 8)


def test_hot_texts_and_rows_without_text_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(translations, "HOT_ROWS", 50)
    store = TranslationStore(spark, f"{tmp_path}/store", 4)
    rows = spark.range(600).selectExpr("id AS prompt_id", "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN concat('t', id) END AS text", "'fr' AS language")
    got = store.translate(rows, translator, "prompt_id").collect()
    assert len(got) == 600 and all(r.translated == (r.text and f"fr:{r.text}") for r in got)


def test_a_worker_holds_the_texts_of_one_call_only():
    """Each call's rows go out before the next call is made, whatever the size of the Arrow batch."""
    calls = []

    def fn(texts, language):
        calls.append((language, list(texts)))
        return [None if t == "n" else f"{language}:{t}" for t in texts]

    rows = [("a", "fr"), ("b", "de"), (None, "fr"), ("c", None), ("n", "fr"), ("d", "fr"), ("e", "fr")]
    batch = pa.RecordBatch.from_pydict({"text_key": [str(k).encode() for k in range(len(rows))], "language": [x for _, x in rows], "text": [t for t, _ in rows]})
    out = translations.translated_rows(fn, 2)(iter([batch, batch.slice(0, 0)]))
    assert next(out).to_pylist() == [{"text_key": b"0", "language": "fr", "translated": "fr:a"}, {"text_key": b"4", "language": "fr", "translated": None}]
    assert calls == [("fr", ["a", "n"])]
    assert [r["translated"] for part in out for r in part.to_pylist()] == ["fr:d", "fr:e", "de:b"]
    assert calls[1:] == [("fr", ["d", "e"]), ("de", ["b"])]
