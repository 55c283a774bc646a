"""Vector analytics on activation/embedding tables.

* direction maths (ablation, patching, addition) as ``zip_with``/``aggregate``
  array expressions; the direction is a scalar subquery (one array), not a join;
* projections: PCA fitted on one set and applied to another (Spark ML, with
  the centring and sign convention of the study), scope-wise standardisation;
* a logistic probe by Spark ML with in-sample accuracy (the study's probes are
  in ``probes``); the rank-based AUC is computed with a distributed cumulative sum
  (range partitioning + per-partition offsets), never a single-task sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.session import cut_lineage, join_checked

EPS = 1e-8


def as_double_array(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def with_unit(df: DataFrame, d: str, out: str) -> DataFrame:
    """``out = d / (||d|| + 1e-8)``.

    The norm is its own column first: inside an array lambda an outer
    expression is re-evaluated for every element, which would make this
    quadratic in the vector width.  The lambda names the column twice (a
    null guard) so the optimizer does not inline the norm back into it
    (it inlines a costly expression only when it is referenced once).
    """
    n = F.col("_norm")
    return df.withColumn("_norm", norm(F.col(d))) \
        .withColumn(out, F.transform(d, lambda x: F.when(n.isNull(), F.lit(None)).otherwise(x / (n + F.lit(EPS))))) \
        .drop("_norm")


def with_ablation(df: DataFrame, a: str, u: str, out: str) -> DataFrame:
    """Remove the component along unit direction ``u``: ``a - (a.u) u``.

    The projection is computed once per row (see ``with_unit`` for why the
    lambda names it twice).
    """
    p = F.col("_proj")
    return df.withColumn("_proj", dot(F.col(a), F.col(u))) \
        .withColumn(out, F.zip_with(a, u, lambda x, y: F.when(p.isNull(), F.lit(None)).otherwise(x - p * y))) \
        .drop("_proj")


def with_patch(df: DataFrame, a: str, u: str, coeff: float, out: str) -> DataFrame:
    """Set the component along ``u`` to ``coeff``: ``a - (a.u) u + c u``."""
    d = with_ablation(df, a, u, "_ablated")
    return d.withColumn(out, F.zip_with("_ablated", u, lambda x, y: x + F.lit(coeff) * y)).drop("_ablated")


def add(a: Column, v: Column, coeff: float) -> Column:
    """Activation addition ``a + c v`` (element-wise, linear in the width)."""
    return F.zip_with(a, v, lambda x, y: x + F.lit(coeff) * y)


def with_mean_difference(df: DataFrame, source: DataFrame, vec: str, label: str,
                         out: str = "direction") -> DataFrame:
    """Adds ``out`` = mean(label=1) - mean(label=0) of ``source``, element-wise.

    Vector means are map-side partial aggregates (``Summarizer``); each mean
    is a scalar subquery (one array of dimension ``d``) that every row reads
    as a constant — no join against the vectors.
    """
    v = source.select(F.col(label).alias("_l"), array_to_vector(as_double_array(F.col(vec))).alias("_v"))
    means = v.groupBy("_l").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m"))
    # both class means in one scalar subquery (labels are 0/1: max_by -> 1, min_by -> 0)
    both = means.agg(F.struct(F.max_by("_m", "_l").alias("pos"), F.min_by("_m", "_l").alias("neg"))).scalar()
    d = df.withColumn("_means", both)
    return d.withColumn(out, F.zip_with("_means.pos", "_means.neg", lambda x, y: x - y)).drop("_means")


# --- projection -----------------------------------------------------------------

def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.withColumn("_features", array_to_vector(as_double_array(F.col(vec))))


def pca_fit_apply(fit_df: DataFrame, apply_df: DataFrame, vec: str, k: int = 2) -> DataFrame:
    """PCA fitted on ``fit_df`` and applied to ``apply_df``.

    Centred with the *fit* set's mean (Spark's PCA does not centre); each
    component's sign is chosen so that its largest-magnitude loading is
    positive.  Adds ``pc`` (array<double> of length k).
    """
    fit_v, app_v = _vectors(fit_df, vec), _vectors(apply_df, vec)
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="_features", outputCol="_centered").fit(fit_v)
    pca = PCA(k=k, inputCol="_centered", outputCol="_pc").fit(scaler.transform(fit_v))
    loadings = pca.pc.toArray()  # d x k, bounded by the vector dimension
    signs = [1.0 if loadings[np.argmax(np.abs(loadings[:, j])), j] >= 0 else -1.0 for j in range(k)]
    out = pca.transform(scaler.transform(app_v))
    arr = vector_to_array(F.col("_pc"))
    return out.withColumn("pc", F.array(*[arr[j] * F.lit(signs[j]) for j in range(k)])) \
        .drop("_features", "_centered", "_pc")


def standardize(df: DataFrame, cols: Sequence[str], scope: Sequence[str] = ()) -> DataFrame:
    """Population standardisation (mean 0, population std 1) per scope.

    Statistics are one aggregate row per scope, joined back with a size-checked
    broadcast; without scopes they are scalar subqueries.
    """
    scope = list(scope)
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"_mu_{c}"), F.stddev_pop(c).alias(f"_sd_{c}")]
    if scope:
        stats = df.groupBy(*scope).agg(*aggs)
        j = join_checked(df, stats, scope)
    else:
        stats = df.agg(*aggs)
        j = df.withColumns({c: stats.select(c).scalar() for c in stats.columns})
    for c in cols:
        j = j.withColumn(f"{c}_std", F.try_divide(F.col(c) - F.col(f"_mu_{c}"), F.col(f"_sd_{c}")))
    return j.drop(*[x for c in cols for x in (f"_mu_{c}", f"_sd_{c}")])


# --- probes -----------------------------------------------------------------------

def fit_probe(df: DataFrame, features: Sequence[str], label: str):
    """Logistic probe matching an L2 (C=1) classifier on unstandardised features.

    The C=1 objective ``sum(loss) + ||w||^2 / 2`` equals Spark's
    ``mean(loss) + regParam ||w||^2 / 2`` up to a factor n with ``regParam = 1/n``.
    """
    data = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df) \
        .withColumn("_y", F.col(label).cast("double"))
    n = data.count()
    est = LogisticRegression(featuresCol="_x", labelCol="_y", maxIter=1000, regParam=1.0 / max(n, 1),
                             elasticNetParam=0.0, standardization=False, tol=1e-7, family="binomial")
    model = est.fit(data)
    return model, model.transform(data)


def accuracy(pred: DataFrame) -> float:
    return pred.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]


def cumulative_before(df: DataFrame, order: str, value: str, n_parts: int) -> DataFrame:
    """Adds ``_before`` = sum of ``value`` over rows strictly earlier in ``order``.

    Range partitioning gives ordered slices; each slice is summed locally and
    shifted by the total of the slices before it (one row per partition).
    ``order`` must be unique (e.g. distinct scores).

    The slice ids are materialised (reliable checkpoint) before they are used
    twice: two independent range exchanges could sample different bounds.
    """
    r = cut_lineage(df.repartitionByRange(n_parts, order).withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    totals = r.groupBy("_pid").agg(F.sum(value).alias("_t"))
    offsets = totals.withColumn(
        "_off", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    # one row per range slice: bounded by ``n_parts``
    return r.join(F.broadcast(offsets.select("_pid", "_off")), "_pid") \
        .withColumn("_before", F.col("_off") + F.col("_local")).drop("_pid", "_local", "_off")


def auc_rank(df: DataFrame, score: str, label: str, group: str, n_parts: int = 64) -> DataFrame:
    """ROC AUC per group by the rank (Mann-Whitney) formula, ties averaged.

    Rows collapse to distinct (group, score) with positive/negative counts
    (partial aggregation), then negatives below each score come from a
    distributed cumulative sum over the distinct scores.
    """
    g = df.groupBy(group, score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                                     F.count_if(F.col(label) == 0).alias("_neg"))
    g = g.withColumn("_ord", F.struct(F.col(group), F.col(score)))
    c = cumulative_before(g, "_ord", "_neg", n_parts)
    # negatives before the group's first score are subtracted per group
    start = c.groupBy(group).agg(F.min("_before").alias("_start"))
    c = join_checked(c, start, group)
    per = c.groupBy(group).agg(
        F.sum(F.col("_pos") * ((F.col("_before") - F.col("_start")) + F.col("_neg") / 2.0)).alias("_num"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))
    return per.select(group, "n_pos", "n_neg",
                      F.try_divide(F.col("_num"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"))
