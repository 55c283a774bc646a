"""Exact order statistics of skewed groups by refinement.

The value at a rank is found without sorting a group: a random sample gives
splitters, one aggregation counts the rows between them, and only the interval
that holds the rank is looked at again, until it is short (or a single value).
Each round narrows a group to about one part in ``SPLITS`` whatever its values
are: no range is assumed, so outliers, continuous values, text and structs are
all the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.session import cut_lineage, join_checked

#: Intervals of a round.
SPLITS = 64
#: Rows of an interval that are counted value by value instead of being split again.
SMALL = 100_000
_SAMPLED = 4


def _inside(value: Column) -> Column:
    return (F.col("_lo").isNull() | (value > F.col("_lo"))) & (F.col("_hi").isNull() | (value <= F.col("_hi")))


def values_at(df: DataFrame, groups: Sequence[str], value: str, targets: DataFrame, splits: int | None = None, small: int | None = None) -> DataFrame:
    """``groups, target, value, below`` for each row ``groups, target, rank`` of ``targets`` (ranks from 1, a few a group).

    ``below`` is the number of the group's rows under that value.  Nulls have
    no rank; a rank outside its group gives no row.  What is moved, kept and
    broadcast (after a size check) is a few rows a group and round; equal
    values are counted in the tasks, so one that fills a group is one row.
    """
    groups, splits, small = list(groups), splits or SPLITS, small or SMALL
    if not groups:
        one = F.lit(0).alias("_all")
        return values_at(df.select(one, value), ["_all"], value, targets.select(one, "*"), splits, small).drop("_all")
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).alias("_v"))
    kind = rows.schema["_v"].dataType
    counts = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    state = cut_lineage(targets.join(counts, groups).where(F.col("rank").between(1, F.col("_n"))).select(
        *groups, "target", F.col("rank").cast("long").alias("rank"), F.lit(None).cast(kind).alias("_lo"), F.lit(None).cast(kind).alias("_hi"),
        F.lit(0).cast("long").alias("_below"), "_n", F.lit(False).alias("_stuck")))
    interval = F.dense_rank().over(Window.partitionBy(*groups).orderBy("_lo")).alias("_i")
    on = [*groups, "_i"]

    def met(table: DataFrame) -> DataFrame:
        """All rows that lie in an interval of ``table``."""
        return join_checked(rows, table, groups).where(_inside(F.col("_v")))

    while not state.where(~F.col("_stuck") & (F.col("_n") > small)).isEmpty():
        state = state.select("*", interval)
        open_ = state.where(~F.col("_stuck") & (F.col("_n") > small))
        places = open_.select(*on, "_lo", "_hi", "_n").distinct()
        drawn = met(places).where(F.rand(17) < F.lit(float(splits * _SAMPLED)) / F.col("_n"))
        cuts = drawn.groupBy(*on).agg(F.sort_array(F.collect_set("_v")).alias("_s"))
        cuts = places.join(cuts, on, "left").select(*on, "_lo", "_hi", "_n", F.filter("_s", lambda x, k: k % _SAMPLED == 0).alias("_s"))
        cuts = cut_lineage(cuts.withColumn("_s", F.coalesce("_s", F.array().cast(cuts.schema["_s"].dataType))))  # the sample is drawn once
        slot = F.size(F.filter("_s", lambda x: x < F.col("_v")))
        hist = met(cuts).groupBy(*on, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_m"))
        upto = Window.partitionBy(*on).orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("_cum", F.sum("_m").over(upto))
        at = F.col("rank") - F.col("_below")
        hit = open_.drop("_lo", "_hi", "_n").join(cuts, on).join(hist, on).where((at <= F.col("_cum")) & (at > F.col("_cum") - F.col("_m")))
        new = hit.select(
            *groups, "target", "rank", F.coalesce(F.get("_s", F.col("_slot") - 1), F.col("_lo")).alias("_lo"), F.coalesce(F.get("_s", F.col("_slot")), F.col("_hi")).alias("_hi"),
            (F.col("_below") + F.col("_cum") - F.col("_m")).alias("_below"), F.col("_m").alias("_n"), (F.col("_m") == F.col("_n")).alias("_stuck"))
        done = state.where(F.col("_stuck") | (F.col("_n") <= small)).drop("_i")
        state = cut_lineage(done.unionByName(new))
    state = state.select("*", interval)
    single = met(state.select(*on, "_lo", "_hi").distinct()).groupBy(*on, "_v").agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy(*on).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    single = single.withColumn("_cum", F.sum("_m").over(upto))
    at = F.col("rank") - F.col("_below")
    hit = state.drop("_lo", "_hi").join(single, on).where((at <= F.col("_cum")) & (at > F.col("_cum") - F.col("_m")))
    return hit.select(*groups, "target", F.col("_v").alias("value"), (F.col("_below") + F.col("_cum") - F.col("_m")).alias("below"))


def first_by_order(df: DataFrame, groups: Sequence[str], k: DataFrame | Column | int, key: str) -> DataFrame:
    """The first ``k`` rows of each group in the order of ``key``, ties by a digest of the whole row.

    ``k`` is a number, a Column over the group keys (or a scalar subquery), or
    a DataFrame ``(groups..., k)``.  A group of fewer rows is kept whole, one
    without a ``k`` is dropped; rows without a key come last and are not drawn.
    Only rows equal in all columns are told apart by a sort.
    """
    groups = list(groups)
    if not groups:
        return first_by_order(df.withColumn("_all", F.lit(0)), ["_all"], k, key).drop("_all")
    d = df.withColumn("_o", F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("k"), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("t"))))
    sizes = d.where("_o IS NOT NULL").groupBy(*groups).agg(F.count(F.lit(1)).alias("_size"))
    wanted = sizes.join(k.select(*groups, F.col("k").alias("_k")), groups) if isinstance(k, DataFrame) else sizes.withColumn("_k", k if isinstance(k, Column) else F.lit(k))
    wanted = cut_lineage(wanted.where("_k > 0").select(*groups, F.least("_k", "_size").cast("long").alias("rank"), F.lit(0).alias("target")))
    cut = values_at(d, groups, "_o", wanted).join(wanted, [*groups, "target"]).select(*groups, F.col("value").alias("_cut"), (F.col("rank") - F.col("below")).alias("_need"))
    j = join_checked(d, cut, groups)
    below = j.where(F.col("_o") < F.col("_cut"))
    same = j.where(F.col("_o") == F.col("_cut")).withColumn("_rn", F.row_number().over(Window.partitionBy(*groups, "_o").orderBy("_o")))
    return below.unionByName(same.where("_rn <= _need").drop("_rn")).select(df.columns)
