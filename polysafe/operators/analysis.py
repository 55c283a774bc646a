"""Score analysis over the long score table.

Input is the long table ``(model, prompt_type, language, category, ord,
refusal, over_refusal)`` — one row per training composition, prompt type and
evaluation language.  Its size is bounded by the dimensions (compositions x
prompt types x languages), never by the corpus, so every operator here is a
small aggregate or window over it; joins against it are broadcast-sized by
construction.  The wide matrices of the study are pivots at the sink only.

Three different harmonic aggregates exist and are kept apart:
* ``harmonic_of_means``: harmonic of the mean refusal and mean over-refusal;
* ``mean_of_harmonics``: mean of the per-language harmonic scores;
* ``category_harmonic``: harmonic of the category means.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.dims import CATEGORY_LABEL, CATEGORY_ORDER, COMPOSITIONS, LanguageDim
from polysafe.functions.scores import (complement, composition_arity, harmonic, in_distribution,
                                       marker_weight)

RUN = ["model", "prompt_type"]


def score_table(totals: DataFrame, dim: LanguageDim) -> DataFrame:
    """Per-language totals -> long score table (harmful score includes *uncertain*)."""
    return totals.where(F.col("language").isin(dim.codes)).select(
        "model", "prompt_type", "language",
        dim.category_col(F.col("language")).alias("category"),
        dim.ord_col(F.col("language")).alias("ord"),
        F.col("refusal_score").alias("refusal"),
        F.col("over_refusal_score").alias("over_refusal"))


def harmonic_cells(ref: DataFrame, over: DataFrame, keys: Sequence[str] = ("model", "prompt_type", "language"),
                   strict: bool = True) -> DataFrame:
    """Cell-wise harmonic of a refusal and an over-refusal table (full outer on keys).

    ``strict`` rejects unequal shapes: a key present on one side only raises
    when the row is evaluated (no extra job).
    """
    keys = list(keys)
    j = ref.select(*keys, F.col("refusal")).join(over.select(*keys, F.col("over_refusal")), keys, "full_outer")
    h = harmonic(F.col("refusal"), F.col("over_refusal"))
    if strict:
        h = F.when(F.col("refusal").isNull() != F.col("over_refusal").isNull(),
                   F.raise_error(F.lit("refusal and over-refusal tables differ in shape")).cast("double")) \
            .otherwise(h)
    return j.select(*keys, "refusal", "over_refusal", h.alias("harmonic"))


def with_harmonic(scores: DataFrame) -> DataFrame:
    return scores.withColumn("harmonic", harmonic(F.col("refusal"), F.col("over_refusal")))


def margins(scores: DataFrame) -> DataFrame:
    """Heat-map margins, long form ``(prompt_type, matrix, model, language, value)``.

    refusal / over_refusal: mean per model (``language='mean'``), mean per
    language (``model='mean'``) and the corner = mean of the model means.
    harmonic: mean and sample std per model and per language; no corners.
    """
    h = with_harmonic(scores)
    long = h.unpivot(["model", "prompt_type", "language"], ["refusal", "over_refusal", "harmonic"],
                     "matrix", "value")
    per_model = long.groupBy("prompt_type", "matrix", "model").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    per_lang = long.groupBy("prompt_type", "matrix", "language").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    is_h = F.col("matrix") == "harmonic"
    model_rows = per_model.select("prompt_type", "matrix", "model", F.lit("mean").alias("language"),
                                  F.col("mean").alias("value")).unionByName(
        per_model.where(is_h).select("prompt_type", "matrix", "model", F.lit("std").alias("language"),
                                     F.col("std").alias("value")))
    lang_rows = per_lang.select("prompt_type", "matrix", F.lit("mean").alias("model"), "language",
                                F.col("mean").alias("value")).unionByName(
        per_lang.where(is_h).select("prompt_type", "matrix", F.lit("std").alias("model"), "language",
                                    F.col("std").alias("value")))
    corner = per_model.where(~is_h).groupBy("prompt_type", "matrix").agg(F.avg("mean").alias("value")) \
        .select("prompt_type", "matrix", F.lit("mean").alias("model"), F.lit("mean").alias("language"), "value")
    return model_rows.unionByName(lang_rows).unionByName(corner)


def harmonic_of_means(scores: DataFrame) -> DataFrame:
    g = scores.groupBy(*RUN).agg(F.avg("refusal").alias("mean_refusal"),
                                 F.avg("over_refusal").alias("mean_over_refusal"))
    return g.withColumn("harmonic", harmonic(F.col("mean_refusal"), F.col("mean_over_refusal")))


def mean_of_harmonics(scores: DataFrame) -> DataFrame:
    return with_harmonic(scores).groupBy(*RUN).agg(F.avg("harmonic").alias("mean_harmonic"))


def category_means(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    return scores.groupBy(*RUN, *keys, "category").agg(
        F.avg("refusal").alias("mean_refusal"), F.avg("over_refusal").alias("mean_over_refusal"))


def category_harmonic(scores: DataFrame) -> DataFrame:
    c = category_means(scores)
    return c.select(*RUN, "category",
                    F.element_at(F.create_map(*[x for k, v in CATEGORY_LABEL.items() for x in (F.lit(k), F.lit(v))]),
                                 F.col("category")).alias("category_label"),
                    "mean_refusal", "mean_over_refusal",
                    harmonic(F.col("mean_refusal"), F.col("mean_over_refusal")).alias("harmonic"))


def baseline_diff(df: DataFrame, value: str, partition: Sequence[str], baseline: str = "en") -> DataFrame:
    """``value - value of the baseline model`` within each partition (no self-join)."""
    w = Window.partitionBy(*partition)
    base = F.max(F.when(F.col("model") == baseline, F.col(value))).over(w)
    return df.withColumn(f"{value}_diff", F.col(value) - base)


def with_in_distribution(scores: DataFrame) -> DataFrame:
    return scores.withColumn("in_dist", F.when(in_distribution(F.col("language"), F.col("model")), F.lit("In"))
                             .otherwise(F.lit("Out")))


def in_out_means(scores: DataFrame) -> DataFrame:
    g = with_in_distribution(scores).groupBy(*RUN, "in_dist").agg(
        F.avg("refusal").alias("mean_refusal"), F.avg("over_refusal").alias("mean_over_refusal"))
    return g.withColumn("harmonic", harmonic(F.col("mean_refusal"), F.col("mean_over_refusal")))


def in_out_category(scores: DataFrame) -> DataFrame:
    """Mean per (run, in/out, category) on a dense skeleton; empty cells are null."""
    s = with_in_distribution(scores)
    g = s.groupBy(*RUN, "in_dist", "category").agg(
        F.avg("refusal").alias("mean_refusal"), F.avg("over_refusal").alias("mean_over_refusal"))
    runs = scores.select(*RUN).distinct()
    skeleton = (runs.select("*", F.explode(F.array(F.lit("In"), F.lit("Out"))).alias("in_dist"))
                .select("*", F.explode(F.array(*[F.lit(c) for c in CATEGORY_ORDER])).alias("category")))
    d = skeleton.join(g, [*RUN, "in_dist", "category"], "left")
    return d.withColumn("harmonic", harmonic(F.col("mean_refusal"), F.col("mean_over_refusal")))


def score_points(scores: DataFrame) -> DataFrame:
    """Scatter table: x = refusal, y = 100 - over-refusal; points with a null coordinate skipped."""
    return scores.select(
        *RUN, "language",
        F.col("refusal").alias("x"), complement(F.col("over_refusal")).alias("y"),
        composition_arity(F.col("model")).alias("arity"),
        marker_weight(F.col("model")).alias("marker_size"),
        (F.col("model") == "en").alias("is_baseline"),
    ).dropna(subset=["x", "y"])


def dimension_order(language: Column, dim: LanguageDim) -> Column:
    """Position of a language in the dimension's order (high, then middle, then low)."""
    return dim.ord_col(language)


def composition_order(scores: DataFrame, model: str = "model", order: Sequence[str] = COMPOSITIONS) -> Column:
    """Listed compositions first in list order, then the others of ``scores`` by name, each with its own position.

    The names of the others (as many as there are runs) come as a scalar subquery.
    """
    listed, own = F.array(*[F.lit(c) for c in order]), F.col(model)
    others = scores.where(~own.isin(list(order))).agg(F.sort_array(F.collect_set(own))).scalar()
    pos = F.array_position(listed, own)
    return F.when(pos > 0, pos).otherwise(len(order) + F.array_position(others, own)).cast("int")


def vanilla_vs_adversarial(scores: DataFrame, strict: bool = False) -> DataFrame:
    """Side by side per (model, language); only keys present for both prompt types.

    ``strict``: an empty intersection is an error (checked on the small score
    table, one aggregate).
    """
    h = with_harmonic(scores)
    wide = h.groupBy("model", "language").pivot("prompt_type", ["vanilla", "adversarial"]).agg(
        F.first("refusal").alias("refusal"), F.first("over_refusal").alias("over_refusal"),
        F.first("harmonic").alias("harmonic"))
    both = wide.where(F.col("vanilla_refusal").isNotNull() & F.col("adversarial_refusal").isNotNull())
    if strict and both.isEmpty():
        raise ValueError("no common languages and compositions between the vanilla and adversarial scores")
    return both.withColumn("model_ord", composition_order(both))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Box-plot statistics per group: quartiles (linear interpolation), 1.5 IQR whiskers, outliers.

    Exact percentiles hold each group's values in memory; groups here are
    bounded by the number of compositions/languages.
    """
    keys = list(keys)
    v = F.col(value)
    w = Window.partitionBy(*keys)
    q = df.where(v.isNotNull()).select(
        *keys, v.alias("v"),
        F.percentile(v, 0.25).over(w).alias("q1"),
        F.percentile(v, 0.5).over(w).alias("median"),
        F.percentile(v, 0.75).over(w).alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return q.groupBy(*keys, "q1", "median", "q3").agg(
        F.count("v").alias("n"),
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("n_outliers"))


def language_means(scores: DataFrame) -> DataFrame:
    """Per eval language: mean harmonic over models, and over models where it is out of distribution."""
    s = with_in_distribution(with_harmonic(scores))
    return s.groupBy("prompt_type", "language").agg(
        F.avg("harmonic").alias("mean_harmonic"),
        F.avg(F.when(F.col("in_dist") == "Out", F.col("harmonic"))).alias("mean_harmonic_out"))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def transpose_scores(scores: DataFrame, dim: LanguageDim, value: str = "harmonic") -> DataFrame:
    """Matrix with compositions as rows and languages as columns."""
    return with_harmonic(scores).groupBy("prompt_type", "model").pivot("language", dim.codes).agg(F.first(value))


def in_out_keys_wide(scores: DataFrame) -> DataFrame:
    """One row per run, one column per (in/out, category) key."""
    d = in_out_category(scores).withColumn(
        "key", F.concat_ws("_", F.col("in_dist"), F.col("category")))
    keys = [f"{i}_{c}" for i in ("In", "Out") for c in CATEGORY_ORDER]
    return d.groupBy(*RUN).pivot("key", keys).agg(F.first("harmonic"))
