"""End-to-end jobs: the study's entry points as Spark jobs over files.

* ``evaluate_runs``      — every run/checkpoint output file -> cleaned, language-
                            identified, classified outputs (written, partitioned)
                            -> dense refusal matrices -> nested score JSON;
* ``evaluate_translated``  — the same runs once more on answers translated to English;
* ``build_eval_prompts``   — prompt files -> drawn, fanned out, translated evaluation prompts;
* ``translate_training``   — the training split in its training languages;
* ``build_training_split`` — corpus -> two disjoint language subsets + rest;
* ``analyse_scores``     — nested score JSON of many compositions -> score table
                            and its roll-ups;
* ``probe_latent_space`` — activation table -> probe metrics per (language, layer).

All runs are one job each (run attributes are group keys, not loops), and
intermediate results that are read several times are written tables.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polysafe.dims import STUDY_LANGUAGES, LanguageDim
from polysafe.functions.text import first_segment, iso_code, normalize_text
from polysafe.operators import analysis, corpus, metrics, probes, sampling, scoring
from polysafe.session import cut_lineage
from polysafe.sources import readers, sinks
from polysafe.sources.translations import Translator, TranslationStore

RUN_KEYS = ["model", "checkpoint", "prompt_type"]
OUTPUT_SCHEMA = ("prompt string, data_type string, language string, language_category string, "
                 "label int, output string")


def evaluate_runs(spark: SparkSession, runs_root: str, out_root: str, dim: LanguageDim = STUDY_LANGUAGES,
                  detector=scoring.reference_detector, language_id=scoring.stopword_language_id,
                  glob: str = "*.csv") -> DataFrame:
    """Score every new run file and return the dense refusal matrix of all runs.

    Outputs already scored (same model and checkpoint) are not scored again.
    ``privacy_fictional`` rows are not sent to the models (they are never
    counted) but stay in the table for the harmful denominator.
    """
    scored_path = os.path.join(out_root, "scored")
    raw = readers.discover_runs(spark, runs_root, glob)
    # pandas writes whole numbers beside missing ones as 0.0
    number = {"int": lambda c: c.cast("double").cast("int")}
    raw = raw.select("model", "checkpoint", *[number.get(t, lambda c, t=t: c.cast(t))(F.col(c)).alias(c) for c, t in
                                              (x.split() for x in OUTPUT_SCHEMA.split(", "))])
    raw = _pending_runs(raw, sinks.read_increments(spark, scored_path, RUN_KEYS))
    keep = metrics.not_privacy(F.col("data_type"))
    d = metrics.with_prompt_type(raw).withColumn("output_clean", first_segment(F.col("output")))
    d = scoring.apply_model(d, language_id, "output_clean", "_lid", mask=keep)
    d = d.withColumn("language_response", iso_code(F.col("_lid"), F.col("language"))).drop("_lid")
    d = scoring.classify_refusal(d, detector, "output_clean", "refusal", mask=keep)
    sinks.write_increment(d, scored_path, RUN_KEYS)
    scored = sinks.read_increments(spark, scored_path, RUN_KEYS)
    return _write_scores(metrics.refusal_matrix(scored, dim, RUN_KEYS), os.path.join(out_root, "scores"))


def _pending_runs(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    """Rows of the runs that are not in a finished increment (read from the folder names alone)."""
    return rows if done is None else corpus.pending_keys(rows, done.select("model", "checkpoint").distinct(), ["model", "checkpoint"])


def _write_scores(matrix: DataFrame, path: str) -> DataFrame:
    long = matrix.unpivot([*RUN_KEYS, "language", "language_response"], metrics.PCT_COLS, "metric", "pct")
    nested = sinks.nested_json(long, [*RUN_KEYS, "metric"], "language", "language_response", "pct")
    sinks.write_nested_json(nested, path, [*RUN_KEYS, "metric"])
    return matrix


def evaluate_translated(spark: SparkSession, out_root: str, store_path: str, translator: Translator, dim: LanguageDim = STUDY_LANGUAGES,
                        detector=scoring.reference_detector) -> DataFrame:
    """The translated variant of runs that ``evaluate_runs`` has scored: its refusal matrix, written beside the first one.

    Answers to low- and middle-resource prompts that are not in English, not of
    the last class and not a known refusal go to English through the
    translation store (each distinct answer once, over all runs and calls) and
    are judged again; answers that ask to rephrase are no refusals.  Runs done
    before are not done again.
    """
    scored = sinks.read_increments(spark, os.path.join(out_root, "scored"), RUN_KEYS)
    if scored is None:
        raise ValueError(f"no scored runs under {out_root}")
    path = os.path.join(out_root, "translated")
    todo = _pending_runs(scored, sinks.read_increments(spark, path, RUN_KEYS))
    todo = todo.withColumn("output_normalized", normalize_text(F.col("output_clean")))
    wanted = scoring.needs_translation_mask(todo) & scoring.not_reference() & metrics.not_privacy(F.col("data_type"))
    todo = todo.withColumns({"_sent": F.when(wanted, F.col("output_clean")), "_to": F.lit("en")})
    row = F.xxhash64("model", "checkpoint", "prompt_type", "prompt", "language")
    todo = cut_lineage(todo.withColumn("_row", row))  # read by the request, its hot texts and the lookup
    found = TranslationStore(spark, store_path).translate(todo, translator, "_row", "_sent", "_to")
    d = scoring.rescore_translated(found.withColumnRenamed("translated", "output_translated").drop("_sent", "_to", "_row"), detector)
    sinks.write_increment(scoring.without_rephrase(d), path, RUN_KEYS)
    judged = sinks.read_increments(spark, path, RUN_KEYS)
    return _write_scores(metrics.refusal_matrix(judged, dim, RUN_KEYS, class_col="refusal_without_rephrase"), os.path.join(out_root, "scores_translated"))


def translate_training(split: DataFrame, store_path: str, translator: Translator, key: str = "row_key") -> DataFrame:
    """Training rows in their training language: instruction and response translated, the text rendered anew.

    ``split`` has ``instruction, chosen_response, text, language``; English
    rows stay as they are.  A field without a translation keeps its row out of
    no later run: it is asked for again.
    """
    store = TranslationStore(split.sparkSession, store_path)
    foreign = F.col("language") != "en"
    out = split
    for field in ("instruction", "chosen_response"):
        sent = cut_lineage(out.withColumns({"_sent": F.when(foreign, F.col(field))}))
        found = store.translate(sent, translator, key, "_sent").withColumn(field, F.when(foreign, F.col("translated")).otherwise(F.col(field)))
        out = found.drop("_sent", "translated")
    text = corpus.render_prompt(F.col("instruction"), F.col("chosen_response"))
    return out.withColumn("text", F.when(foreign, text).otherwise(F.col("text"))).select(split.columns)


def build_eval_prompts(spark: SparkSession, harmful_path: str, quotas: dict[str, int], harmless_path: str, n_harmless: int,
                       adversarial_path: str, store_path: str, translator: Translator, dim: LanguageDim = STUDY_LANGUAGES,
                       out_path: str | None = None) -> DataFrame:
    """The evaluation prompts: vanilla harmful and harmless in every language, and the adversarial ones.

    Harmful prompts are JSON files, ``quotas`` of each drawn; harmless ones are
    a CSV file of typed prompts of which the safe ones are drawn, ``n_harmless``
    a type; adversarial ones are a CSV file that is in all languages already.
    Returns ``prompt, data_type, language, language_category, label``, written
    as an increment per call when ``out_path`` is given.
    """
    harmful = readers.read_prompt_files(spark, harmful_path).select(
        F.col("instructions").alias("source"), F.col("type").alias("data_type"), F.lit(1).alias("label"))
    keyed = harmful.withColumn("_key", F.concat_ws("|", "data_type", "source"))
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col("data_type"))
    drawn = sampling.sample_quota(keyed, ["data_type"], quota, "_key")
    safe = readers.read_csv(spark, harmless_path).where("label = 'safe'").select(
        F.col("prompt").alias("source"), F.col("type").alias("data_type"), F.lit(0).alias("label"))
    safe = sampling.sample_per_group(safe.withColumn("_key", F.concat_ws("|", "data_type", "source")), ["data_type"], n_harmless, "_key", strict=True)
    vanilla = cut_lineage(corpus.fan_out(drawn.unionByName(safe), dim))
    sent = vanilla.withColumn("_sent", F.when(F.col("language") != "en", F.col("source")))
    found = TranslationStore(spark, store_path).translate(sent, translator, "_key", "_sent")
    columns = ["prompt", "data_type", "language", "language_category", "label"]
    vanilla = found.withColumn("prompt", F.when(F.col("language") == "en", F.col("source")).otherwise(F.col("translated"))).select(columns)
    adversarial = readers.read_csv(spark, adversarial_path).withColumnRenamed("adversarial", "prompt").withColumn("label", F.col("label").cast("int"))
    out = vanilla.unionByName(adversarial.select(columns))
    if out_path:
        sinks.write_increment(out, out_path, ["language"])
        out = sinks.read_increments(spark, out_path, ["language"])
    return out


def build_training_split(instructions: DataFrame, safety: DataFrame, n_safety: int, fraction: float,
                         lg1: str, lg2: str, out_path: str | None = None) -> DataFrame:
    """Formatted instruction + safety rows -> disjoint subsets -> training language (lg2 > lg1 > en)."""
    c = instructions.unionByName(safety).select(
        F.concat_ws(":", F.col("safety").cast("string"), F.col("prompt_id").cast("string")).alias("row_key"),
        "safety", "category", "text", "instruction", "chosen_response")
    split = corpus.split_subsets(c.select("row_key", "safety", "category", "text"), n_safety, fraction)
    out = split.join(c, ["row_key", "safety", "category"]) \
        .withColumn("language", corpus.training_language(F.col("lg_subset"), lg1, lg2))
    if out_path:
        sinks.write_table(out, out_path, ["language"])
    return out


def analyse_scores(spark: SparkSession, scores_root: str, dim: LanguageDim = STUDY_LANGUAGES) -> dict[str, DataFrame]:
    """Nested score JSON (``.../model=.../prompt_type=.../metric=...``) -> score table and roll-ups.

    Harmful score = refusal + uncertain (harmful); over-refusal = refusal on harmless.
    """
    long = readers.read_nested_scores(spark, scores_root)
    attrs = {k: F.regexp_extract("file_path", f"{k}=([^/]+)", 1) for k in ("model", "prompt_type", "metric")}
    long = long.select(*[v.alias(k) for k, v in attrs.items()], "language", "language_response", "pct")
    def total(metric: str) -> Column:
        return F.sum(F.when(F.col("metric") == metric, F.col("pct")))

    # a refusal table without its table of uncertain answers is an error, not a lower score
    unmatched = F.raise_error(F.concat(F.lit("no uncertain_harmful scores for "), F.concat_ws(" ", "model", "prompt_type", "language")))
    sums = long.groupBy("model", "prompt_type", "language").agg(
        total("refusal").alias("_refusal"), total("uncertain_harmful").alias("_uncertain"), total("over_refusal").alias("over_refusal"))
    per_lang = sums.select("model", "prompt_type", "language", "over_refusal", F.when(
        F.col("_refusal").isNotNull() & F.col("_uncertain").isNull(), unmatched.cast("double")).otherwise(F.col("_refusal") + F.col("_uncertain")).alias("refusal"))
    scores = per_lang.where(F.col("language").isin(dim.codes)).select(
        "model", "prompt_type", "language", dim.category_col(F.col("language")).alias("category"),
        dim.ord_col(F.col("language")).alias("ord"), "refusal", "over_refusal")
    return {
        "scores": scores,
        "harmonic": analysis.with_harmonic(scores),
        "margins": analysis.margins(scores),
        "harmonic_of_means": analysis.harmonic_of_means(scores),
        "mean_of_harmonics": analysis.mean_of_harmonics(scores),
        "category_harmonic": analysis.category_harmonic(scores),
        "in_out": analysis.in_out_means(scores),
        "in_out_category": analysis.in_out_category(scores),
        "points": analysis.score_points(scores),
    }


def probe_latent_space(spark: SparkSession, acts: DataFrame, kind: str = "logistic", out_path: str | None = None) -> DataFrame:
    """Seven probes for every language and every fourth layer, on the components of the layer's balanced rows."""
    a = probes.every_fourth_layer(acts)
    out = probes.probe_metrics(probes.project(a, probes.components(probes.fit_set(a))), ["language", "layer"], kind)
    if out_path:
        sinks.write_metrics(out, out_path)
    return out
