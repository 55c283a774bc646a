"""The adapters' data exercise the operators: both outcomes of every flag occur."""

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from polysafe.operators import sampling
from polysafe.plans.queries import REGISTRY, assistant_turns, normalized_outputs
from polysafe.sources import readers


@pytest.mark.parametrize(("name", "flag"), [
    ("hard_lang_route", "cost_class"), ("rephrase_override", "rephrase"), ("normalized_match", "is_reference_refusal"),
    ("translate_stub", "translated"), ("needs_translation", "language_response")])
def test_both_outcomes_occur(spark, name, flag):
    assert REGISTRY[name](spark, SF01).select(flag).where(F.col(flag).isNotNull()).distinct().count() >= 2


def test_text_rules_change_more_than_blanks(spark):
    changed = REGISTRY["clean_output"](spark, SF01).join(assistant_turns(spark, SF01), ["conv_id", "turn"])
    assert changed.where(F.trim("output") != F.trim("output_clean")).count() > 20
    n = normalized_outputs(spark, SF01)
    assert n.where("output_clean <> output_normalized").count() > 100
    assert n.where("output_clean like '%&amp;%' and output_normalized not like '%&amp;%'").count() > 0
    assert n.where("output_clean like '%ċ%' and output_normalized not like '%ċ%'").count() > 0


def test_every_document_reaches_the_text_operators(spark):
    assert normalized_outputs(spark, SF01).count() == spark.read.parquet(f"{SF01}/documents.parquet").count()


def test_draw_cuts_every_category(spark):
    rows = REGISTRY["language_draw"](spark, SF01).collect()
    assert sorted((r.category) for r in rows) == ["high"] * 3 + ["low"] * 3 + ["middle"] * 3
    assert not {"en", "fr", "de"} & {r.language for r in rows}


def test_dropped_token_occurs(spark):
    from polysafe.plans.queries import DROPPED_TOKEN

    words = spark.read.parquet(f"{SF01}/documents.parquet").select(F.explode(F.split("text", " ")).alias("w"))
    assert words.where(F.length("w") == DROPPED_TOKEN).count() > 0


def test_balanced_classes_with_an_empty_class(spark):
    rows = [(k, "harmless", 0) for k in range(5)] + [(10, "harmful", 0)]
    df = spark.createDataFrame(rows, "key long, kind string, refusal int")
    keep = {"harmful": 1, "harmless": 0}
    assert sampling.balanced_classes(df, "kind", "refusal", keep, "key").collect() == []
    more = df.unionByName(spark.createDataFrame([(20, "harmful", 1), (21, "harmful", 1)], df.schema))
    assert sorted(r.key for r in sampling.balanced_classes(more, "kind", "refusal", keep, "key").collect()) == [0, 1, 20, 21]


def test_files_of_two_layouts_are_read_by_name(spark, tmp_path):
    for model, name, body in (("en", "checkpoint-5", ",prompt,label,output\n0,p1,1,\"a\nb\"\n"), ("fr", "checkpoint-6", "output,prompt,label\nc,p2,0\n"),
                              ("de", "checkpoint-0", "prompt\nskipped\n"), ("de", "checkpoint-7", "prompt,label\np3,1\n")):
        (tmp_path / "runs" / model).mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / model / f"run-{name}.csv").write_text(body)
    got = {r.prompt: (r.model, r.checkpoint, r.label, r.output) for r in readers.discover_runs(spark, f"{tmp_path}/runs").collect()}
    assert got == {"p1": ("en", "5", "1", "a\nb"), "p2": ("fr", "6", "0", "c"), "p3": ("de", "7", "1", None)}
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "a.csv").write_text(",x,y\n0,1,u\n")
    (tmp_path / "tables" / "b.csv").write_text("y,x\nv,2\n")
    got = readers.read_csv(spark, f"{tmp_path}/tables", "x int, y string, z double").collect()
    assert sorted(map(tuple, got)) == [(1, "u", None), (2, "v", None)]
    assert sorted((r.x, r.y) for r in readers.read_csv(spark, f"{tmp_path}/tables").collect()) == [(1, "u"), (2, "v")]
