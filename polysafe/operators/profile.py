"""Column profiles per group (``describe()``-style) that survive skewed groups.

* text columns: count, unique, top (most frequent; tie -> smallest SHA-256
  digest), freq.  Only digests are shuffled; the top text itself is fetched
  with one broadcast row per group.
* numeric columns: count, mean, sample std, min, quartiles, max.  Quartiles
  are exact (linear interpolation, as numpy/pandas) without holding a group,
  or all its distinct values, in one task: see ``selection``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.operators.selection import values_at
from polysafe.session import cut_lineage, join_checked


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, of discrete or continuous values: two ranks a quantile, by refinement."""
    groups = list(groups)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    at = F.lit(1.0) * (F.col("_size") - 1)
    ends = [F.struct(F.lit(2 * i + up).alias("target"), (end(F.lit(q) * at) + 1).alias("rank"), (F.lit(q) * at - F.floor(F.lit(q) * at)).alias("_part"))
            for i, q in enumerate(qs) for up, end in enumerate((F.floor, F.ceil))]
    targets = cut_lineage(sizes.select(*groups, F.inline(F.array(*ends))))
    found = values_at(df, groups, value, targets).join(targets, [*groups, "target"])
    pick = [[F.max(F.when(F.col("target") == 2 * i + up, F.col(c))) for up, c in ((0, "value"), (1, "value"), (0, "_part"))] for i in range(len(qs))]
    return found.groupBy(*groups).agg(*[(lo + (hi - lo) * part).cast("double").alias(f"q{int(round(q * 100))}") for q, (lo, hi, part) in zip(qs, pick)])


def text_profile(df: DataFrame, groups: Sequence[str], text: str) -> DataFrame:
    groups = list(groups)
    d = df.select(*groups, F.sha2(F.col(text), 256).alias("_tk"), F.col(text).isNotNull().alias("_nn"))
    per_text = d.where("_nn").groupBy(*groups, "_tk").agg(F.count(F.lit(1)).alias("_cnt"))
    best = per_text.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("unique"), F.sum("_cnt").alias("count"),
        F.min_by(F.col("_tk"), F.struct(-F.col("_cnt"), F.col("_tk"))).alias("_top_tk"),
        F.max("_cnt").alias("freq"))
    # One winning digest per group, broadcast after a size check: texts are
    # filtered map-side and never shuffled.
    winners = best.select(*groups, "_top_tk")
    cand = df.select(*groups, F.col(text).alias("top"), F.sha2(F.col(text), 256).alias("_top_tk"))
    top = join_checked(cand, winners, [*groups, "_top_tk"], "left_semi") \
        .groupBy(*groups).agg(F.min("top").alias("top"))
    return best.join(top, groups, "left").select(*groups, "count", "unique", "top", "freq")


def numeric_profile(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    groups = list(groups)
    base = df.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"), F.max(value).cast("double").alias("max"))
    q = exact_quantiles(df, groups, value, [0.25, 0.5, 0.75])
    return base.join(q, groups, "left")
