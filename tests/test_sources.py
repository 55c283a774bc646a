"""Sources and sinks: round trips through files in a scratch folder."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF001
from polysafe.sources import readers, sinks
from polysafe.sources.tables import read_table


def _docs(spark, n=30):
    return read_table(spark, SF001, "documents", "doc_id", "text", "lang").orderBy("doc_id").limit(n)


def test_csv_roundtrip_multiline_quotes(spark, scratch):
    df = spark.createDataFrame([(1, 'say "hi"\nnext line', "en"), (2, "a,b", None)], "id int, text string, lang string")
    p = os.path.join(scratch, "t.csv")
    # pandas-style file with an index column
    df.toPandas().to_csv(p)
    back = readers.read_csv(spark, p, "id int, text string, lang string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi"\nnext line', "en"), (2, "a,b", None)]


def test_tsv(spark, scratch):
    p = os.path.join(scratch, "s.tsv")
    with open(p, "w") as f:
        f.write("vanilla\tdata_type\nhello\tvanilla_harmful\n")
    r = readers.read_tsv(spark, p).first()
    assert (r["vanilla"], r["data_type"]) == ("hello", "vanilla_harmful")


def test_prompt_files_keep_type(spark, scratch):
    d = os.path.join(scratch, "prompts")
    os.makedirs(d)
    for name, items in {"cyber": ["a", "b"], "bio": ["c"]}.items():
        with open(os.path.join(d, f"{name}.json"), "w") as f:
            json.dump([{"instructions": x} for x in items], f)
    rows = readers.read_prompt_files(spark, d).select("instructions", "type").orderBy("instructions").collect()
    assert [tuple(r) for r in rows] == [("a", "cyber"), ("b", "cyber"), ("c", "bio")]


def test_taxonomy_and_line_list(spark, scratch):
    t = os.path.join(scratch, "tax.txt")
    with open(t, "w") as f:
        f.write("French,x,y,5\nLao,z,1\n\n")
    rows = readers.read_taxonomy(spark, t).orderBy("language").collect()
    assert [tuple(r) for r in rows] == [("French", "5"), ("Lao", "1")]
    l = os.path.join(scratch, "langs.txt")
    with open(l, "w") as f:
        f.write("french\n lao \nmaltese")
    assert sorted(r[0] for r in readers.read_line_list(spark, l).collect()) == ["french", "lao", "maltese"]


def test_nested_score_json_roundtrip(spark, scratch):
    long = spark.createDataFrame([("m", "en", "en", 10.0), ("m", "en", "other", 5.0), ("m", "fr", "en", 1.5)],
                                 "model string, language string, language_response string, pct double")
    nested = sinks.nested_json(long, ["model"], "language", "language_response", "pct")
    doc = json.loads(nested.first()["json"])
    assert doc == {"en": {"en": 10.0, "other": 5.0}, "fr": {"en": 1.5}}
    out = os.path.join(scratch, "scores")
    sinks.write_nested_json(nested, out, ["model"])
    back = readers.read_nested_scores(spark, out).orderBy("language", "language_response").collect()
    assert [(r["language"], r["language_response"], r["pct"]) for r in back] == [
        ("en", "en", 10.0), ("en", "other", 5.0), ("fr", "en", 1.5)]
    assert all("model=m" in r["file_path"] for r in back)


def test_discover_runs_one_scan(spark, scratch):
    root = os.path.join(scratch, "runs")
    for model, ckpts in {"fr": ["0", "100"], "fr_pt": ["100"]}.items():
        os.makedirs(os.path.join(root, model))
        for c in ckpts:
            with open(os.path.join(root, model, f"checkpoint-{c}.csv"), "w") as f:
                f.write(",prompt,label\n0,hello,1\n")
        with open(os.path.join(root, model, "result.json"), "w") as f:
            f.write("{}")
    rows = readers.discover_runs(spark, root).select("model", "checkpoint", "prompt").orderBy("model").collect()
    assert [tuple(r) for r in rows] == [("fr", "100", "hello"), ("fr_pt", "100", "hello")]


def test_partitioned_table_sink_and_pruned_read(spark, scratch):
    df = _docs(spark).select("doc_id", "text", F.col("lang").alias("language"),
                             F.lit("vanilla").alias("prompts_type"), F.lit("train").alias("split"),
                             F.when(F.col("doc_id") % 2 == 0, "harmful").otherwise("harmless").alias("harmtype"))
    out = os.path.join(scratch, "prompts")
    sinks.write_table(df, out, ["prompts_type", "split", "harmtype", "language"])
    part = readers.read_prompt_partition(spark, out, "vanilla", "train", "harmful", "en")
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partitionFilters" in plan.lower()
    assert part.count() == df.where((F.col("harmtype") == "harmful") & (F.col("language") == "en")).count()


def test_append_language_increments(spark, scratch):
    out = os.path.join(scratch, "fanout")
    d = _docs(spark, 10).select("doc_id", F.col("lang").alias("language"))
    sinks.append_language(d.where(F.col("language") == "en"), out)
    sinks.append_language(d.where(F.col("language") != "en"), out)
    assert sinks.read_increments(spark, out, ["language"]).count() == 10
    assert sinks.read_increments(spark, os.path.join(scratch, "nothing"), ["language"]) is None


def test_metrics_json_sink(spark, scratch):
    m = spark.createDataFrame([("all", "harmful", 0.9, 0.95)], "scope string, target string, accuracy double, auc double")
    out = os.path.join(scratch, "metrics")
    sinks.write_metrics(m, out)
    assert spark.read.json(out).first()["auc"] == 0.95


def test_resume_anti_join(spark):
    from polysafe.operators.corpus import pending_keys
    wanted = spark.createDataFrame([(1, "fr"), (1, "de"), (2, "fr")], "item_id long, language string")
    done = spark.createDataFrame([(1, "fr", "x")], "item_id long, language string, translated string")
    assert sorted(tuple(r) for r in pending_keys(wanted, done, ["item_id", "language"]).collect()) == [(1, "de"), (2, "fr")]


def test_read_split_override(spark, scratch):
    root = os.path.join(scratch, "corpora")
    _docs(spark, 5).write.parquet(os.path.join(root, "org/ultrafeedback_binarized/train_prefs"))
    assert readers.read_split(spark, root, "org/ultrafeedback_binarized", "train").count() == 5
