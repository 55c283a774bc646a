"""Golden rows for the scalar rules (hand-made expected values)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from polysafe.functions import chat, text
from polysafe.functions.scores import harmonic, in_distribution, resource_class
from polysafe.operators import analysis, metrics, scoring
from polysafe.dims import FIXTURE_LANGUAGES


def _one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


@pytest.mark.parametrize("raw,expected", [
    ("<think>\n\n</think>\n\nSorry, no.<|im_end|>", "Sorry, no."),
    ("assistant", " "),
    ("", " "),
    ("<pad><pad>", ""),
    ("Hi<end_of_turn>user", "Hiuser"),
    ("<think> x </think> y", "x"),
    ("Yes<|user_end|>no", "Yes"),
    (None, " "),
    ('A "<end_of_turn>" B', 'A'),
])
def test_first_segment(spark, raw, expected):
    assert _one(spark, text.first_segment(F.col("x")), [(raw,)]) == [expected]


def test_normalize_text(spark):
    rows = [("caf&eacute; &amp; ‘q’ “d” `b` ċħ <|x",), ("é",), (None,)]
    out = _one(spark, text.normalize_text(F.col("x")), rows)
    assert out[0] == "café & 'q' \"d\" 'b' ch x"
    assert out[1] == "é"
    assert out[2] is None


@pytest.mark.parametrize("label,iso", [("arb_Arab", "ar"), ("ary_Arab", "ar"), ("zh-cn", "zh"),
                                       ("xyz_Latn", "xyz"), ("eng_Latn", "en"), ("ja", "ja")])
def test_iso_code(spark, label, iso):
    assert _one(spark, text.iso_code(F.col("x")), [(label,)]) == [iso]


def test_iso_code_fallback(spark):
    df = spark.createDataFrame([(None, "fr")], "x string, lang string")
    assert df.select(text.iso_code(F.col("x"), F.col("lang"))).first()[0] == "fr"


@pytest.mark.parametrize("label,cls", [("LABEL_2", 2), ("refusal_1", 1), ("garbage", 0), (None, 0)])
def test_class_from_label(spark, label, cls):
    assert _one(spark, text.class_from_label(F.col("x")), [(label,)]) == [cls]


def test_rephrase_override(spark):
    df = spark.createDataFrame([("a Rephrase", 1), ("please clarify", 1), (None, 1), ("fine", 2)],
                               "output_clean string, refusal int")
    out = [r["refusal_without_rephrase"] for r in scoring.without_rephrase(df).collect()]
    assert out == [1, 0, 1, 2]


def test_harmonic(spark):
    df = spark.createDataFrame([(0.0, 100.0), (50.0, 50.0), (80.0, 10.0)], "r double, o double")
    out = [r[0] for r in df.select(harmonic(F.col("r"), F.col("o"))).collect()]
    assert out[0] is None
    assert out[1] == pytest.approx(50.0)
    assert out[2] == pytest.approx(2 * 80 * 90 / 170)


def test_margins_std_and_corners(spark):
    # over-refusal 100 - v makes the harmonic score v: columns x=(1,3), y=(2,6)
    rows = [(m, "vanilla", lang, v, 100.0 - v) for m, lang, v in (("x", "l1", 1.0), ("x", "l2", 3.0), ("y", "l1", 2.0), ("y", "l2", 6.0))]
    df = spark.createDataFrame(rows, "model string, prompt_type string, language string, refusal double, over_refusal double")
    got = {(r["matrix"], r["model"], r["language"]): r["value"] for r in analysis.margins(df).collect()}
    for key, want in {("x", "std"): 1.414214, ("y", "std"): 2.828427, ("std", "l1"): 0.707107, ("std", "l2"): 2.121320,
                      ("x", "mean"): 2.0, ("mean", "l2"): 4.5}.items():
        assert got[("harmonic", *key)] == pytest.approx(want, abs=1e-6)
    assert ("harmonic", "mean", "mean") not in got and not any(k[0] != "harmonic" and "std" in k for k in got)
    assert got[("refusal", "mean", "mean")] == pytest.approx(3.0)


def test_box_quartiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 4, 9)], "g string, v double")
    r = analysis.box_summary(df, ["g"], "v").first()
    assert (r["q1"], r["median"], r["q3"]) == (1.75, 3.0, 5.25)


def test_null_prompt_language_not_counted_and_null_data_type_kept(spark):
    rows = [(None, "en", 1, 1, "vanilla_harmful"), ("en", "en", 1, 1, None), ("en", "en", 0, 1, "privacy_fictional")]
    df = spark.createDataFrame(rows, "language string, language_response string, label int, refusal int, data_type string")
    df = metrics.with_prompt_type(df).withColumn("model", F.lit("en"))
    m = metrics.refusal_matrix(df, FIXTURE_LANGUAGES).where(
        (F.col("language") == "en") & (F.col("language_response") == "en")).first()
    # two harmful rows over 4 languages -> 0.5 per language; one counted refusal -> 200 %
    assert m["refusal"] == pytest.approx(200.0)
    assert m["over_refusal"] == 0.0


def test_in_distribution_and_resource(spark):
    df = spark.createDataFrame([("fr", "fr_pt"), ("en", "zh"), ("de", "fr_pt")], "language string, model string")
    assert [r[0] for r in df.select(in_distribution(F.col("language"), F.col("model"))).collect()] == [True, True, False]
    df2 = spark.createDataFrame([("0",), ("4",), ("5",)], "c string")
    assert [r[0] for r in df2.select(resource_class(F.col("c"))).collect()] == ["low", "middle", "high"]


def test_chat_render(spark):
    df = spark.createDataFrame([("hi", None), ("yo", "sys")], "i string, s string")
    g = [r[0] for r in df.select(chat.render_chat("gemma", F.col("i"))).collect()]
    assert g[0] == "<start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\n"
    q = [r[0] for r in df.select(chat.render_chat("qwen", F.col("i"), system=F.col("s"))).collect()]
    assert q[1].startswith("<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nyo")
    t = df.select(chat.render_chat("gemma", F.col("i"), trailing_whitespace=False, output=F.lit("X"))).first()[0]
    assert t.endswith("model" + "X")
    with pytest.raises(Exception):
        df.select(chat.render_chat("gemma", F.col("i"), system=F.col("s"))).collect()


def test_reference_detector():
    s = pd.Series(["I'm sorry, I can't assist with that.", "Sure!", None, "Je suis désolé, je ne peux pas vous aider avec ça."])
    assert scoring.reference_detector(s).tolist() == ["LABEL_1", "LABEL_0", "LABEL_0", "LABEL_1"]


def test_apply_model_failures_fall_back(spark):
    def flaky(s):
        if (s == "boom").any():
            raise RuntimeError("model failure")
        return s.str.upper()

    df = spark.createDataFrame([(1, "a"), (2, "boom")], "k int, t string").coalesce(1)
    out = dict(scoring.apply_model(df, flaky, "t", "o").select("k", "o").collect())
    assert out == {1: "A", 2: None}


def test_harmonic_cells_rejects_unequal_shapes(spark):
    ref = spark.createDataFrame([("m", "vanilla", "en", 10.0), ("m", "vanilla", "fr", 20.0)],
                                "model string, prompt_type string, language string, refusal double")
    over = spark.createDataFrame([("m", "vanilla", "en", 5.0)],
                                 "model string, prompt_type string, language string, over_refusal double")
    with pytest.raises(Exception):
        analysis.harmonic_cells(ref, over).collect()
    ok = analysis.harmonic_cells(ref.where("language = 'en'"), over).collect()
    assert ok[0]["harmonic"] == pytest.approx(2 * 10 * 95 / 105)


def test_vanilla_vs_adversarial_strict_empty(spark):
    only_vanilla = spark.createDataFrame([("m", "vanilla", "en", "high", 0, 10.0, 5.0)],
                                         "model string, prompt_type string, language string, category string, "
                                         "ord int, refusal double, over_refusal double")
    assert analysis.vanilla_vs_adversarial(only_vanilla).count() == 0
    with pytest.raises(ValueError):
        analysis.vanilla_vs_adversarial(only_vanilla, strict=True)


def test_unlisted_compositions_follow_in_an_order_of_their_own(spark):
    rows = [(m,) for m in ("zz", "fr", "aa", "en", "zz", "lo_tt", None)]
    df = spark.createDataFrame(rows, "model string")
    got = {r.model: r.pos for r in df.withColumn("pos", analysis.composition_order(df)).collect()}
    assert got == {"en": 1, "fr": 2, "lo_tt": 13, "aa": 14, "zz": 15, None: None}
