"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each builder reads whole driver tables and returns a DataFrame.  Several run
jobs while they are built (fits, quotas, checkpoints, written tables); what
reaches the driver is bounded by the study's dimensions.  Column names equal
those of the matching oracle SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polysafe.dims import FIXTURE_LANGUAGES as DIM
from polysafe.dims import HARD_LANGUAGES, ISO_CODES, LANGUAGE_DRAW_SEED, STUDY_LANGUAGES
from polysafe.functions import chat
from polysafe.functions import text as tx
from polysafe.functions.scores import display_round, resource_class
from polysafe.operators import analysis, corpus, metrics, probes, profile, sampling, scoring
from polysafe.operators import vectors as vx
from polysafe.plans.adapters import FIXTURE_RUNS, activations, eval_rows, marked, model_outputs, safety_rows
from polysafe.session import checkpoint_dir, cut_lineage, ensure_parallel
from polysafe.sources import sinks
from polysafe.sources.tables import read_table
from polysafe.sources.translations import TranslationStore, text_digest

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = fn
        return fn
    return deco


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.with_prompt_type(eval_rows(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense cell counts, checkpointed: one pass over the outputs, then every
    analysis reads a few hundred rows from the shared checkpoint folder."""
    return cut_lineage(metrics.refusal_cell_counts(typed_rows(spark, sf_dir), DIM))


@register("refusal_matrix")
def q_refusal_matrix(spark, sf_dir):
    return metrics.refusal_matrix(typed_rows(spark, sf_dir), DIM)


@register("refusal_by_response_wide")
def q_refusal_wide(spark, sf_dir):
    return metrics.refusal_wide(q_refusal_matrix(spark, sf_dir), DIM)


@register("refusal_totals")
def q_refusal_totals(spark, sf_dir):
    return metrics.totals(cells(spark, sf_dir))


@register("class_stack")
def q_class_stack(spark, sf_dir):
    return metrics.class_stack(cells(spark, sf_dir))


# --- score analysis -------------------------------------------------------


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.score_table(metrics.totals(cells(spark, sf_dir)), DIM)


@register("harmonic_cell")
def q_harmonic_cell(spark, sf_dir):
    s = scores(spark, sf_dir)
    keys = ["model", "prompt_type", "language"]
    return analysis.harmonic_cells(s.select(*keys, "refusal"), s.select(*keys, "over_refusal"), keys)


@register("harmonic_margins")
def q_harmonic_margins(spark, sf_dir):
    return analysis.margins(scores(spark, sf_dir))


@register("harmonic_of_means")
def q_harmonic_of_means(spark, sf_dir):
    return analysis.harmonic_of_means(scores(spark, sf_dir))


@register("mean_of_harmonics")
def q_mean_of_harmonics(spark, sf_dir):
    return analysis.mean_of_harmonics(scores(spark, sf_dir))


@register("category_harmonic")
def q_category_harmonic(spark, sf_dir):
    return analysis.category_harmonic(scores(spark, sf_dir))


@register("baseline_diff")
def q_baseline_diff(spark, sf_dir):
    h = analysis.with_harmonic(scores(spark, sf_dir)).select("model", "prompt_type", "language", "harmonic")
    return analysis.baseline_diff(h, "harmonic", ["prompt_type", "language"])


@register("category_diff")
def q_category_diff(spark, sf_dir):
    c = analysis.category_harmonic(scores(spark, sf_dir)).select("model", "prompt_type", "category", "harmonic")
    return analysis.baseline_diff(c, "harmonic", ["prompt_type", "category"])


@register("in_out_means")
def q_in_out_means(spark, sf_dir):
    return analysis.in_out_means(scores(spark, sf_dir))


@register("in_out_category")
def q_in_out_category(spark, sf_dir):
    return analysis.in_out_category(scores(spark, sf_dir))


@register("ood_diff")
def q_ood_diff(spark, sf_dir):
    """Out-of-distribution category scores less those of the English-only run."""
    c = analysis.in_out_category(scores(spark, sf_dir)).where(F.col("in_dist") == "Out").select("model", "prompt_type", "category", "harmonic")
    return analysis.baseline_diff(c, "harmonic", ["prompt_type", "category"])


@register("score_points")
def q_score_points(spark, sf_dir):
    return analysis.score_points(scores(spark, sf_dir))


@register("vanilla_vs_adversarial")
def q_vanilla_vs_adversarial(spark, sf_dir):
    return analysis.vanilla_vs_adversarial(scores(spark, sf_dir))


@register("box_summary")
def q_box_summary(spark, sf_dir):
    h = analysis.with_in_distribution(analysis.with_harmonic(scores(spark, sf_dir)))
    by_lang = analysis.box_summary(h.withColumn("grp", F.col("language")), ["prompt_type", "grp"], "harmonic")
    by_cat = analysis.box_summary(h.withColumn("grp", F.col("category")), ["prompt_type", "grp"], "harmonic")
    by_io = analysis.box_summary(h.withColumn("grp", F.col("in_dist")), ["prompt_type", "grp"], "harmonic")
    return (by_lang.withColumn("grouping", F.lit("language"))
            .unionByName(by_cat.withColumn("grouping", F.lit("category")))
            .unionByName(by_io.withColumn("grouping", F.lit("in_dist"))))


@register("language_means")
def q_language_means(spark, sf_dir):
    return analysis.language_means(scores(spark, sf_dir))


@register("melt_scores")
def q_melt_scores(spark, sf_dir):
    models = [m for m, _ in FIXTURE_RUNS]
    h = analysis.with_harmonic(scores(spark, sf_dir))
    wide = h.groupBy("prompt_type", "category", "language").pivot("model", models).agg(
        F.first("harmonic"))
    return analysis.melt(wide, ["prompt_type", "category", "language"], models, "model", "value")


@register("transpose_scores")
def q_transpose_scores(spark, sf_dir):
    return analysis.transpose_scores(scores(spark, sf_dir), DIM)


@register("in_out_keys_wide")
def q_in_out_keys_wide(spark, sf_dir):
    return analysis.in_out_keys_wide(scores(spark, sf_dir))


# --- sampling and corpora -------------------------------------------------

SAMPLE_N = 5
QUOTA_N, PROP_BENIGN = 20, 0.5
FRACTION = 0.1
GLOBAL_N = 100
CEIL_RATIO = 0.05
SPLIT_N_SAFETY, SPLIT_FRACTION = 5, 0.1
BASE_HARMLESS_PER_SOURCE, NEW_HARMLESS = 3, 20


def documents(spark, sf_dir, *cols):
    return read_table(spark, sf_dir, "documents", *(cols or ("doc_id", "text", "lang", "source", "n_chars")))


@register("sample_per_group")
def q_sample_per_group(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source", "lang")
    return sampling.sample_per_group(d, ["source"], SAMPLE_N, "doc_id")


@register("sample_quota")
def q_sample_quota(spark, sf_dir):
    s = safety_rows(spark, sf_dir).select("prompt_id", "data_type", "label")
    quotas = s.select("data_type").distinct().withColumn(
        "k", F.when(F.col("data_type") == "adversarial_harmful", F.lit(QUOTA_N))
        .otherwise(F.lit(int(QUOTA_N * PROP_BENIGN))).cast("long"))
    return sampling.sample_quota(s, ["data_type"], quotas, "prompt_id")


@register("sample_fraction")
def q_sample_fraction(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "source")
    return sampling.sample_fraction(d, ["source"], FRACTION, "doc_id")


@register("sample_global")
def q_sample_global(spark, sf_dir):
    return sampling.sample_global(documents(spark, sf_dir, "doc_id", "lang"), GLOBAL_N, "doc_id")


@register("sample_ceil")
def q_sample_ceil(spark, sf_dir):
    return sampling.sample_ceil(documents(spark, sf_dir, "doc_id", "source"), CEIL_RATIO, "doc_id")


@register("balanced_classes")
def q_balanced_classes(spark, sf_dir):
    r = eval_rows(spark, sf_dir).where(F.col("model") == "en").select(
        "prompt_id", F.when(F.col("label") == 1, F.lit("harmful")).otherwise(F.lit("harmless")).alias("kind"),
        scoring.binary_class(F.col("refusal")).alias("refusal"))
    return sampling.balanced_classes(r, "kind", "refusal", {"harmful": 1, "harmless": 0}, "prompt_id")


def train_corpus(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    instr = corpus.format_instruction(corpus.first_messages(conv))
    safety = corpus.format_safety(safety_rows(spark, sf_dir))
    return instr.unionByName(safety)


@register("train_text")
def q_train_text(spark, sf_dir):
    return train_corpus(spark, sf_dir)


@register("conversation_pairs")
def q_conversation_pairs(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    p = corpus.first_messages(conv)
    return p.select("conv_id", "instruction", "chosen_response",
                    corpus.instruction_with_input(F.col("instruction"), F.col("system")).alias("prompt_with_input"))


@register("split_subsets")
def q_split_subsets(spark, sf_dir):
    c = train_corpus(spark, sf_dir).select(
        F.concat_ws(":", F.col("safety").cast("string"), F.col("prompt_id").cast("string")).alias("row_key"),
        "safety", "category", "text")
    s = corpus.split_subsets(c, SPLIT_N_SAFETY, SPLIT_FRACTION)
    return s.select("row_key", "safety", "category", F.concat_ws(",", "lg_subset").alias("lg_subset"),
                    corpus.training_language(F.col("lg_subset"), "fr", "pt").alias("language"))


@register("corpus_union")
def q_corpus_union(spark, sf_dir):
    s = safety_rows(spark, sf_dir)
    kind = F.when(F.col("label") == 1, F.lit("harmful")).otherwise(F.lit("harmless"))
    vanilla = s.where(~F.col("data_type").contains("adversarial")).select(
        "prompt_id", F.col("vanilla").alias("prompt"), "language", kind.alias("prompt_category"),
        F.col("source").alias("note"))
    adv = s.where(F.col("data_type").contains("adversarial")).select(
        "prompt_id", F.col("adversarial").alias("prompt"), "language", "label", "data_type")
    return vanilla.unionByName(adv, allowMissingColumns=True)


def benchmark_fanout(spark, sf_dir):
    b = read_table(spark, sf_dir, "benchmark", "item_id", "text")
    return corpus.fan_out(b, DIM)


def translation_store(spark, sf_dir):
    return documents(spark, sf_dir, "doc_id", "lang", "text").select(
        F.col("doc_id").alias("item_id"), F.col("lang").alias("language"), F.col("text").alias("translated"))


@register("prompt_language_fanout")
def q_prompt_language_fanout(spark, sf_dir):
    return benchmark_fanout(spark, sf_dir).select("item_id", "language", "language_category",
                                                  F.col("text").alias("source_text"))


@register("translation_lookup")
def q_translation_lookup(spark, sf_dir):
    j = corpus.lookup_translations(benchmark_fanout(spark, sf_dir), translation_store(spark, sf_dir),
                                   "item_id", "text")
    return j.select("item_id", "language", "prompt", F.col("prompt").isNotNull().alias("has_prompt"))


def label_translator(texts, language):
    """Stand-in for a translation service: the text behind its language."""
    return "[" + language + "] " + texts


@register("translated_prompts")
def q_translated_prompts(spark, sf_dir):
    """Labelled prompts in every language: from a store that has the toxic ones in two of them, the rest from the
    translator, which puts them into the store; the second request, which gives the rows, finds them all there."""
    s = safety_rows(spark, sf_dir).select("prompt_id", F.col("vanilla").alias("text"), "label")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    store = TranslationStore(spark, f"{checkpoint_dir(spark)}/translations-{uuid.uuid4().hex}", buckets)
    have = s.where("label = 1").select("text").distinct().withColumn("language", F.explode(F.array(F.lit("fr"), F.lit("de"))))
    store.add(have.select(text_digest(F.col("text")).alias("text_key"), "language", F.concat_ws(" ", F.lit("stored"), "language", "text").alias("translated")))
    wanted = corpus.fan_out(s, DIM).withColumn("sent", F.when(F.col("language") != "en", F.col("text")))
    found = store.translate(wanted, label_translator, "prompt_id", "sent")
    prompt = F.when(F.col("language") == "en", F.col("text")).otherwise(F.col("translated"))
    return found.select("prompt_id", "language", "language_category", "label", F.length(prompt).cast("long").alias("prompt_chars"), F.md5(prompt).alias("prompt_md5"))


@register("increment_roundtrip")
def q_increment_roundtrip(spark, sf_dir):
    """Evaluated outputs written language class by language class, as increments; each asks for the rows that no finished
    one has, and what is read back are the finished ones."""
    rows = cut_lineage(eval_rows(spark, sf_dir))
    path = f"{checkpoint_dir(spark)}/increments-{uuid.uuid4().hex}"
    keys = ["model", "language"]
    for category in ("high", "middle", "low", "high"):
        done = sinks.read_increments(spark, path, keys)
        wanted = rows.where(F.col("language_category") == category)
        wanted = wanted if done is None else corpus.pending_keys(wanted, done.select(*keys).distinct(), keys)
        sinks.write_increment(wanted, path, keys)
    return sinks.read_increments(spark, path, keys).select("prompt_id", "model", "language", "language_category", "label", "refusal")


@register("pending_keys")
def q_pending_keys(spark, sf_dir):
    wanted = benchmark_fanout(spark, sf_dir).where(F.col("language") != "en").select("item_id", "language")
    return corpus.pending_keys(wanted, translation_store(spark, sf_dir), ["item_id", "language"])


@register("complete_harmless")
def q_complete_harmless(spark, sf_dir):
    s = safety_rows(spark, sf_dir).select("prompt_id", F.col("vanilla").alias("prompt"), "label", "source")
    harmless = s.where(F.col("label") == 0)
    base = corpus.fan_out(sampling.sample_per_group(harmless, ["source"], BASE_HARMLESS_PER_SOURCE, "prompt_id"), DIM)
    base = base.withColumn("is_new", F.lit(False))
    pool = s.withColumn("is_new", F.lit(True))
    out = corpus.complete_harmless(base, pool, NEW_HARMLESS, DIM, "prompt_id")
    return out.select("prompt_id", "language", "language_category", "label", "is_new")


# --- text functions and scoring ------------------------------------------


def assistant_turns(spark, sf_dir):
    c = ensure_parallel(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", F.expr(marked("conv_id", "text")).alias("output"))


@register("clean_output")
def q_clean_output(spark, sf_dir):
    return scoring.clean_outputs(assistant_turns(spark, sf_dir)).select("conv_id", "turn", "output_clean")


def normalized_outputs(spark, sf_dir):
    o = scoring.clean_outputs(model_outputs(spark, sf_dir))
    return scoring.with_normalized(o)


@register("normalized_match")
def q_normalized_match(spark, sf_dir):
    o = scoring.reference_refusal_flags(normalized_outputs(spark, sf_dir), spark)
    return o.select("prompt_id", "output_normalized", "is_reference_refusal")


@register("rephrase_override")
def q_rephrase_override(spark, sf_dir):
    o = scoring.without_rephrase(scoring.clean_outputs(model_outputs(spark, sf_dir)))
    return o.select("prompt_id", "refusal", "rephrase", "refusal_without_rephrase")


@register("needs_translation")
def q_needs_translation(spark, sf_dir):
    o = normalized_outputs(spark, sf_dir)
    sel = scoring.drop_reference_refusals(o.where(scoring.needs_translation_mask(o)), spark)
    return sel.select("prompt_id", "language", "language_response", "refusal")


@register("final_class")
def q_final_class(spark, sf_dir):
    o = normalized_outputs(spark, sf_dir).select(
        "prompt_id", "language_category", "language_response", "refusal", "output_clean", "output_normalized")
    t = scoring.translate_selected(o, spark)
    r = scoring.rescore_translated(t)
    return r.select("prompt_id", "refusal_first", "refusal_translation", "refusal",
                    scoring.binary_class(F.col("refusal")).alias("refusal_binary"))


@register("response_language")
def q_response_language(spark, sf_dir):
    o = scoring.clean_outputs(model_outputs(spark, sf_dir)).select("prompt_id", "language", "output_clean")
    return scoring.detect_language(o).select("prompt_id", "language", "language_response")


@register("translate_stub")
def q_translate_stub(spark, sf_dir):
    o = normalized_outputs(spark, sf_dir).select(
        "prompt_id", "language_category", "language_response", "refusal", "output_clean", "output_normalized")
    t = scoring.translate_selected(o, spark)
    return t.select("prompt_id", F.col("output_translated").isNotNull().alias("translated"),
                    F.length("output_translated").alias("translated_chars"))


@register("iso_codes")
def q_iso_codes(spark, sf_dir):
    inverse = {v: k for k, v in ISO_CODES.items()}
    back = F.create_map(*[x for k, v in inverse.items() for x in (F.lit(k), F.lit(v))])
    d = documents(spark, sf_dir, "doc_id", "lang", "source")
    labels = d.select("doc_id", F.concat(F.coalesce(F.try_element_at(back, F.col("lang")), F.col("lang")),
                                         F.lit("_Latn")).alias("detector_label")) \
        .unionByName(d.select("doc_id", F.concat(F.col("source"), F.lit("_Latn")).alias("detector_label")))
    return labels.select("doc_id", "detector_label", tx.iso_code(F.col("detector_label")).alias("iso"))


def _event_label():
    return F.when(F.col("value") > 50, F.col("event_type")).otherwise(
        F.concat(F.col("event_type"), F.lit("_"), (F.floor(F.col("value")).cast("long") % 4).cast("string")))


@register("class_parse")
def q_class_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "event_type", "value")
    return e.select("event_id", _event_label().alias("label_text")).select(
        "event_id", "label_text", tx.class_from_label(F.col("label_text")).alias("class"))


@register("run_name_parse")
def q_run_name_parse(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    f = F.concat(F.lit("checkpoint-"), F.col("user_id").cast("string"), F.lit(".csv"))
    return e.select("event_id", f.alias("file_name"),
                    tx.checkpoint_number(f).alias("checkpoint"),
                    tx.run_name(F.col("event_type"), F.lit("data"), F.lit("SFT"), F.lit("2e-05")).alias("run_name"))


@register("json_value")
def q_json_value(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_id", "props")
    return e.select("event_id", tx.json_value(F.col("props"), "k").alias("k"))


DROPPED_TOKEN = 7


@register("token_id_filter")
def q_token_id_filter(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "text")
    ids = F.transform(F.split(F.col("text"), " "), lambda w: F.length(w))
    g = tx.generated_ids(ids, F.lit(3), DROPPED_TOKEN)
    return d.select("doc_id", F.size(g).alias("n_generated"),
                    F.aggregate(g, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


# --- chat, language sets, nested scores, profiles ------------------------


def pairs(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return corpus.first_messages(conv)


@register("chat_messages")
def q_chat_messages(spark, sf_dir):
    p = pairs(spark, sf_dir)
    cols = {"user_chat": chat.user_chat(F.col("instruction")),
            "training_chat": chat.training_chat(F.col("instruction"), F.col("chosen_response")),
            "translation_chat": chat.translation_chat(F.col("chosen_response"))}
    out = [F.col("conv_id")]
    for name, arr in cols.items():
        out += [F.concat_ws(",", F.transform(arr, lambda m: m["role"])).alias(f"{name}_roles"),
                F.element_at(arr, -1)["content"].alias(f"{name}_last")]
    return p.select(*out)


@register("chat_render")
def q_chat_render(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select(
        "conv_id",
        chat.render_chat("gemma", F.col("instruction")).alias("gemma_prompt"),
        chat.render_chat("gemma", F.col("instruction"), trailing_whitespace=False,
                         output=F.col("chosen_response")).alias("gemma_with_output"),
        chat.render_chat("qwen", F.col("instruction"), system=F.col("system")).alias("qwen_prompt"))


@register("lang_set_ops")
def q_lang_set_ops(spark, sf_dir):
    present = documents(spark, sf_dir, "lang").select(F.col("lang").alias("language")).distinct()
    study = STUDY_LANGUAGES.frame(spark).select("language")
    used = eval_rows(spark, sf_dir).select(F.explode(F.split("model", "_")).alias("language")).distinct()
    in_study = present.join(study, "language", "left_semi")
    unused = in_study.join(used.select(F.lower("language").alias("language")), "language", "left_anti")
    missing = study.subtract(present)
    tag = lambda df, name: df.select(F.lit(name).alias("set_name"), "language")
    return (tag(present, "present").unionByName(tag(in_study, "in_study"))
            .unionByName(tag(unused, "unused")).unionByName(tag(missing, "study_not_present")))


@register("resource_bins")
def q_resource_bins(spark, sf_dir):
    d = documents(spark, sf_dir, "doc_id", "lang", "source")
    cat = F.regexp_extract(F.col("source"), r"(\d+)", 1).cast("int") % 6
    return d.groupBy("lang", cat.alias("taxonomy_class")).agg(F.count(F.lit(1)).alias("n_docs")) \
        .withColumn("resource", resource_class(F.col("taxonomy_class")))


@register("hard_lang_route")
def q_hard_lang_route(spark, sf_dir):
    """Benchmark prompts in all study languages, routed by cost."""
    rows = corpus.fan_out(read_table(spark, sf_dir, "benchmark", "item_id"), STUDY_LANGUAGES)
    hard = F.col("language").isin(HARD_LANGUAGES)
    return rows.select("item_id", "language", F.when(hard, F.lit("hard")).otherwise(F.lit("easy")).alias("cost_class"),
                       F.when(hard, F.lit(16)).otherwise(F.lit(32)).alias("batch_size"))


@register("language_draw")
def q_language_draw(spark, sf_dir):
    """Three study languages of each category that no run was trained in; too few are an error."""
    used = eval_rows(spark, sf_dir).select(F.explode(F.split("model", "_")).alias("language")).distinct()
    unused = STUDY_LANGUAGES.frame(spark).select("language", "category").join(used, "language", "left_anti")
    return sampling.sample_per_group(unused, ["category"], 3, "language", seed=LANGUAGE_DRAW_SEED, strict=True)


@register("nested_scores_roundtrip")
def q_nested_scores_roundtrip(spark, sf_dir):
    m = metrics.refusal_matrix(typed_rows(spark, sf_dir), DIM)
    long = m.unpivot(["model", "prompt_type", "language", "language_response"], metrics.PCT_COLS, "metric", "pct")
    nested = sinks.nested_json(long, ["model", "prompt_type", "metric"], "language", "language_response", "pct")
    back = sinks.parse_nested_json(nested, ["model", "prompt_type", "metric"], "json")
    return back.groupBy("model", "prompt_type", "metric", "language").agg(
        F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n_responses"))


@register("all_runs_metrics")
def q_all_runs_metrics(spark, sf_dir):
    rows = typed_rows(spark, sf_dir)
    kept = metrics.not_privacy(F.col("data_type"))
    harmful, harmless = F.col("label") == 1, (F.col("label") == 0) & kept
    return rows.groupBy("model", "prompt_type").agg(
        F.count_if(harmful).alias("n_harmful"), F.count_if(harmless).alias("n_harmless"),
        F.count_if(harmful & kept & F.col("refusal").isin(1, 2)).alias("n_refused_harmful"),
        F.count_if(harmless & (F.col("refusal") == 1)).alias("n_refused_harmless"),
        F.count_if(~kept).alias("n_privacy"))


@register("rounded_scores")
def q_rounded_scores(spark, sf_dir):
    h = analysis.with_harmonic(scores(spark, sf_dir))
    return h.select("model", "prompt_type", "language",
                    display_round(F.col("refusal")).alias("refusal"),
                    display_round(F.col("over_refusal")).alias("over_refusal"),
                    display_round(F.col("harmonic")).alias("harmonic"),
                    F.col("prompt_type").contains("adv").alias("is_adversarial"))


@register("language_profile")
def q_language_profile(spark, sf_dir):
    d = documents(spark, sf_dir, "lang", "text", "n_chars")
    t = profile.text_profile(d, ["lang"], "text")
    n = profile.numeric_profile(d, ["lang"], "n_chars").select(
        "lang", *[F.col(c).alias(f"n_chars_{c}") for c in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")])
    return t.join(n, "lang")


@register("class_counts")
def q_class_counts(spark, sf_dir):
    return metrics.class_counts(eval_rows(spark, sf_dir), ["model", "label"])


# --- vector analytics -----------------------------------------------------

PATCH_COEFF, ADD_COEFF = 2.0, 0.5


def _directional(spark, sf_dir):
    a = activations(spark, sf_dir)
    v = a.select("prompt_id", vx.as_double_array(F.col("vec")).alias("a"))
    return vx.with_unit(vx.with_mean_difference(v, a, "vec", "harmful"), "direction", "u")


def _r6(c):
    # "+ 0.0" turns a rounded negative zero into 0.0
    return F.round(c, 6) + F.lit(0.0)


@register("vector_ablate")
def q_vector_ablate(spark, sf_dir):
    v = vx.with_ablation(_directional(spark, sf_dir), "a", "u", "ab")
    return v.select("prompt_id", _r6(vx.dot(F.col("a"), F.col("u"))).alias("proj_before"),
                    _r6(vx.dot(F.col("ab"), F.col("u"))).alias("proj_after"), _r6(vx.norm(F.col("ab"))).alias("norm_after"))


@register("vector_patch")
def q_vector_patch(spark, sf_dir):
    v = vx.with_patch(_directional(spark, sf_dir), "a", "u", PATCH_COEFF, "p")
    return v.select("prompt_id", _r6(vx.dot(F.col("p"), F.col("u"))).alias("proj_after"),
                    _r6(vx.norm(F.col("p"))).alias("norm_after"))


@register("vector_add")
def q_vector_add(spark, sf_dir):
    v = _directional(spark, sf_dir).withColumn("s", vx.add(F.col("a"), F.col("direction"), ADD_COEFF))
    return v.select("prompt_id", _r6(vx.norm(F.col("s"))).alias("norm_after"),
                    _r6(vx.dot(F.col("s"), F.col("u"))).alias("proj_after"))


@register("auc_rank")
def q_auc_rank(spark, sf_dir):
    a = activations(spark, sf_dir).select("prompt_type", "harmful", F.col("vec")[0].cast("double").alias("score"))
    r = vx.auc_rank(a, "score", "harmful", "prompt_type", n_parts=8)
    return r.select("prompt_type", "n_pos", "n_neg", _r6(F.col("auc")).alias("auc"))


def _projection(spark, sf_dir):
    """Every activation of every fourth layer on its layer's two components (fitted on the balanced rows of all languages)."""
    a = probes.every_fourth_layer(activations(spark, sf_dir))
    return probes.project(a, probes.components(probes.fit_set(a))).select(
        "prompt_id", "language", "layer", "harmful", "prompt_type", "refusal", "x", "y")


def _rounded(df, *cols):
    return df.withColumns({c: _r6(F.col(c)) for c in cols})


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    return _rounded(_projection(spark, sf_dir), "x", "y")


@register("standardize_2d")
def q_standardize_2d(spark, sf_dir):
    """Points standardised within their language and layer, over all prompts and over their prompt type."""
    p = _projection(spark, sf_dir)
    scoped = p.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("prompt_type"))))
    return _rounded(probes.standardized(scoped, ["language", "layer", "scope"]), "x", "y", "x_std", "y_std")


@register("probe_metrics")
def q_probe_metrics(spark, sf_dir):
    """The seven probes of each layer over all languages."""
    return _rounded(probes.probe_metrics(_projection(spark, sf_dir), ["layer"]), "accuracy", "auc")


@register("decision_grid")
def q_decision_grid(spark, sf_dir):
    """The three decision boundaries of each layer over all languages."""
    return _rounded(probes.decision_grids(_projection(spark, sf_dir), ["layer"]), "gx", "gy", "decision")


@register("layer_sweep")
def q_layer_sweep(spark, sf_dir):
    """The seven probes of each language and layer."""
    return _rounded(probes.probe_metrics(_projection(spark, sf_dir), ["language", "layer"]), "accuracy", "auc")


@register("translated_refusal_matrix")
def q_translated_refusal_matrix(spark, sf_dir):
    """The translated variant end to end: clean -> normalise -> translate the
    low/middle-resource non-English answers -> re-score -> rephrase override ->
    dense refusal matrix on ``refusal_without_rephrase``."""
    o = normalized_outputs(spark, sf_dir)
    r = scoring.rescore_translated(scoring.translate_selected(o))
    r = scoring.without_rephrase(r).withColumn("model", F.lit("en"))
    return metrics.refusal_matrix(metrics.with_prompt_type(r), DIM, class_col="refusal_without_rephrase")


@register("html_decode")
def q_html_decode(spark, sf_dir):
    """Entity decoding of whole raw pages (Arrow UDF; no SQL counterpart)."""
    p = ensure_parallel(read_table(spark, sf_dir, "pages", "page_id", "html"))
    d = p.select("page_id", tx.html_unescape(F.col("html")).alias("decoded"))
    return d.select("page_id", F.length("decoded").alias("decoded_chars"),
                    F.col("decoded").contains("&amp;").alias("has_amp_entity"))


@register("probe_metrics_svm")
def q_probe_metrics_svm(spark, sf_dir):
    """The linear-SVM probes of each layer over all languages (margins as scores)."""
    return probes.probe_metrics(_projection(spark, sf_dir), ["layer"], kind="svm")
