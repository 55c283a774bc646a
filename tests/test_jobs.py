"""End-to-end jobs over files: evaluation with resume, score analysis, split, probes."""

import os

from pyspark.sql import functions as F

from conftest import SF001
from polysafe.dims import FIXTURE_LANGUAGES
from polysafe.operators import metrics
from polysafe.plans import jobs
from polysafe.plans.adapters import model_outputs
from polysafe.sources import sinks


def _write_run(spark, root, model, ckpt, outputs):
    d = os.path.join(root, model)
    os.makedirs(d, exist_ok=True)
    pdf = outputs.select(F.col("output").alias("prompt"), "data_type", "language", "language_category",
                         "label", "output").toPandas()
    pdf.to_csv(os.path.join(d, f"checkpoint-{ckpt}.csv"))  # with the pandas index column


def test_evaluate_runs_resume_and_analyse(spark, scratch):
    outs = model_outputs(spark, SF001)
    runs, out = os.path.join(scratch, "runs"), os.path.join(scratch, "out")
    _write_run(spark, runs, "fr", "100", outs)
    _write_run(spark, runs, "fr", "0", outs)          # checkpoint 0 is skipped
    m1 = jobs.evaluate_runs(spark, runs, out, FIXTURE_LANGUAGES)
    assert {r["checkpoint"] for r in m1.select("checkpoint").distinct().collect()} == {"100"}
    n_scored = sinks.read_increments(spark, os.path.join(out, "scored"), jobs.RUN_KEYS).count()
    assert n_scored == outs.count()

    _write_run(spark, runs, "fr_pt", "200", outs)     # a new run lands: only it is scored
    m2 = jobs.evaluate_runs(spark, runs, out, FIXTURE_LANGUAGES)
    assert sinks.read_increments(spark, os.path.join(out, "scored"), jobs.RUN_KEYS).count() == 2 * n_scored
    assert m2.select("model", "checkpoint").distinct().count() == 2

    # the dense matrix of one run equals the batch metric on the same outputs
    from polysafe.operators import scoring
    from polysafe.functions.text import first_segment
    direct = metrics.with_prompt_type(outs).withColumn("output_clean", first_segment(F.col("output")))
    direct = scoring.classify_refusal(scoring.detect_language(direct), mask=metrics.not_privacy(F.col("data_type")))
    direct = metrics.refusal_matrix(direct.withColumn("model", F.lit("fr")), FIXTURE_LANGUAGES)
    key = ["prompt_type", "language", "language_response"]
    a = sorted(tuple(r) for r in m2.where("model = 'fr'").select(*key, *metrics.PCT_COLS).collect())
    b = sorted(tuple(r) for r in direct.select(*key, *metrics.PCT_COLS).collect())
    assert a == b

    res = jobs.analyse_scores(spark, os.path.join(out, "scores"), FIXTURE_LANGUAGES)
    s = {(r["model"], r["prompt_type"], r["language"]): r for r in res["scores"].collect()}
    assert len(s) == 2 * 2 * FIXTURE_LANGUAGES.n
    # harmful score = refusal + uncertain over responses; over-refusal = harmless refusals
    m = m2.where("model = 'fr'").groupBy("prompt_type", "language").agg(
        F.sum(F.col("refusal") + F.col("uncertain_harmful")).alias("r"), F.sum("over_refusal").alias("o")).collect()
    for r in m:
        got = s[("fr", r["prompt_type"], r["language"])]
        assert abs(got["refusal"] - r["r"]) < 1e-9 and abs(got["over_refusal"] - r["o"]) < 1e-9
    assert res["harmonic_of_means"].count() == 4


def test_probe_latent_space(spark, scratch):
    from polysafe.plans.adapters import activations
    acts = activations(spark, "/root/testdata/sf0.01").where(F.col("layer") == 27)
    m = jobs.probe_latent_space(spark, acts, out_path=os.path.join(scratch, "probe"))
    assert m.count() == 4 * 7  # the fit languages are judged too
    assert spark.read.json(os.path.join(scratch, "probe")).count() == 28


def _models():
    # closures travel to the workers by value
    def label(texts, language):
        return "[" + language + "] " + texts

    def refuse(texts, language):
        raise AssertionError(f"asked for {list(texts)} in {language}")

    return label, refuse


label, refuse = _models()


def test_a_run_that_dies_while_writing_does_not_count(spark, scratch, monkeypatch):
    import pytest

    outs = model_outputs(spark, SF001)
    runs, out = os.path.join(scratch, "runs"), os.path.join(scratch, "out")
    _write_run(spark, runs, "fr", "007", outs)
    monkeypatch.setattr(sinks, "FINISHED", "no/such/folder/:")  # dies after its data, before the marker
    with pytest.raises(Exception):
        jobs.evaluate_runs(spark, runs, out, FIXTURE_LANGUAGES)
    monkeypatch.undo()
    path = os.path.join(out, "scored")
    assert len(os.listdir(path)) == 1 and sinks.read_increments(spark, path, jobs.RUN_KEYS) is None
    jobs.evaluate_runs(spark, runs, out, FIXTURE_LANGUAGES)
    rows = sinks.read_increments(spark, path, jobs.RUN_KEYS)
    assert rows.count() == outs.count() and {r.checkpoint for r in rows.select("checkpoint").distinct().collect()} == {"007"}


def test_evaluate_translated(spark, scratch):
    from polysafe.functions.text import first_segment, normalize_text
    from polysafe.operators import scoring

    outs = model_outputs(spark, SF001)
    runs, out, store = (os.path.join(scratch, x) for x in ("runs", "out", "store"))
    _write_run(spark, runs, "fr", "100", outs)
    jobs.evaluate_runs(spark, runs, out, FIXTURE_LANGUAGES)
    got = jobs.evaluate_translated(spark, out, store, label, FIXTURE_LANGUAGES)
    scored = sinks.read_increments(spark, os.path.join(out, "scored"), jobs.RUN_KEYS).toPandas()
    judged = sinks.read_increments(spark, os.path.join(out, "translated"), jobs.RUN_KEYS).toPandas()
    refs = set(scoring.normalized_reference_values())
    normal = normalize_text.func(scored.output_clean)
    sent = (scored.language_category.isin(["low", "middle"]) & (scored.language_response != "en") & (scored.refusal != 3)
            & (scored.data_type != "privacy_fictional") & scored.output_clean.notna() & ~normal.isin(refs))
    want = sorted("[en] " + t for t in scored.output_clean[sent])
    assert len(want) > 5 and sorted(judged.output_translated.dropna()) == want
    assert got.count() > 0 and os.path.isdir(os.path.join(out, "scores_translated"))
    again = jobs.evaluate_translated(spark, out, store, refuse, FIXTURE_LANGUAGES)  # nothing is left to ask for
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_translate_training(spark, scratch):
    rows = [("a", 1, "c", "old", "do", "done", "fr"), ("b", 1, "c", "kept", "go", "gone", "en"), ("c", 0, "c", "old", "do", None, "pt")]
    split = spark.createDataFrame(rows, "row_key string, safety int, category string, text string, instruction string, chosen_response string, language string")
    store = os.path.join(scratch, "store")
    got = {r.row_key: r for r in jobs.translate_training(split, store, label).collect()}
    assert (got["a"].instruction, got["a"].chosen_response) == ("[fr] do", "[fr] done") and "[fr] do" in got["a"].text and "[fr] done" in got["a"].text
    assert tuple(got["b"]) == rows[1] and got["c"].instruction == "[pt] do" and got["c"].chosen_response is None
    assert {r.row_key: r for r in jobs.translate_training(split, store, refuse).collect()} == got


def test_build_eval_prompts(spark, scratch):
    import json

    import pandas as pd

    for name, n in (("A", 5), ("B", 3)):
        os.makedirs(os.path.join(scratch, "harmful"), exist_ok=True)
        with open(os.path.join(scratch, "harmful", f"{name}.json"), "w") as f:
            json.dump([{"instructions": f"{name} {k}"} for k in range(n)], f)
    pd.DataFrame([(f"safe {t} {k}", "safe", t, "f", "n") for t in "xy" for k in range(4)] + [("bad", "unsafe", "x", "f", "n")],
                 columns=["prompt", "label", "type", "focus", "note"]).to_csv(os.path.join(scratch, "safe.csv"))
    pd.DataFrame([("attack, \"quoted\"", 1, "adversarial_harmful", "de", "middle")],
                 columns=["adversarial", "label", "data_type", "language", "language_category"]).to_csv(os.path.join(scratch, "adv.csv"))
    args = (os.path.join(scratch, "harmful"), {"A": 2, "B": 3}, os.path.join(scratch, "safe.csv"), 3, os.path.join(scratch, "adv.csv"), os.path.join(scratch, "store"))
    got = jobs.build_eval_prompts(spark, *args, label, FIXTURE_LANGUAGES, os.path.join(scratch, "out")).toPandas()
    assert len(got) == (2 + 3 + 3 + 3) * 4 + 1
    assert got.groupby(["data_type", "language"]).size().to_dict() == {
        **{(t, l): n for t, n in (("A", 2), ("B", 3), ("x", 3), ("y", 3)) for l in FIXTURE_LANGUAGES.codes}, ("adversarial_harmful", "de"): 1}
    plain = got[(got.language == "en")].prompt
    for code in ("fr", "de", "es"):
        assert set(got[(got.language == code) & ~got.prompt.str.startswith("attack")].prompt) == {f"[{code}] {p}" for p in plain}
    assert set(got[got.label == 0].data_type) == {"x", "y"} and "bad" not in set(plain)
    assert len(jobs.build_eval_prompts(spark, *args, refuse, FIXTURE_LANGUAGES).toPandas()) == len(got)


def test_scores_without_their_uncertain_part_are_an_error(spark, scratch):
    import pytest

    for metric in ("refusal", "over_refusal"):
        folder = os.path.join(scratch, "scores", "model=fr", "prompt_type=vanilla", f"metric={metric}")
        os.makedirs(folder)
        with open(os.path.join(folder, "part.txt"), "w") as f:
            f.write('{"en": {"en": 50.0}}')
    with pytest.raises(Exception, match="no uncertain_harmful scores for fr vanilla en"):
        jobs.analyse_scores(spark, os.path.join(scratch, "scores"), FIXTURE_LANGUAGES)["scores"].collect()
