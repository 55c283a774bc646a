"""Deterministic sampling by hash order.

pandas/numpy random streams cannot be reproduced, so the row order of every
draw is ``md5(concat_ws('|', key, seed))`` with the key as tie-break — the
same in Spark and in SQL engines.

``first_k`` makes every exact selection through a histogram over 65,536 order
buckets: rows of buckets below a group's cut are kept by a filter where they
are read, and only the rows of the cut bucket itself (one in 65,536) are
ranked, per *(group, bucket)*.  A group holding a third of the data is never
gathered, no payload is shuffled, and nothing is collected on the driver.
Selections in the order of a key itself, whose values may lie anyhow, go
through ``selection.first_by_order``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.dims import SEED
from polysafe.operators.selection import first_by_order
from polysafe.session import join_checked

N_BUCKETS = 65536


def hash_order(key: Column | str, seed: int = SEED) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", k.cast("string"), F.lit(str(seed))))


def hash_bucket(h: Column) -> Column:
    """First 16 bits of the md5 hex digest (four hex digits): monotone in hash order."""
    def digit(i: int) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1
    return ((digit(1) * 16 + digit(2)) * 16 + digit(3)) * 16 + digit(4)


def sample_per_group(df: DataFrame, groups: Sequence[str], n: int, key: str, seed: int = SEED,
                     strict: bool = False) -> DataFrame:
    """``n`` rows per group, without replacement (W1).  ``strict``: a group smaller than n is an error."""
    groups = list(groups)
    out = first_k_by_hash(df, groups, n, key, seed)
    if strict:
        small = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_cnt")).where(F.col("_cnt") < n)
        check = small.select(*groups, F.raise_error(F.concat(F.lit("group too small for sample of "), F.lit(str(n))))
                             .cast("int").alias("_chk"))
        # the filter keeps the check alive through column pruning; it raises
        # as soon as a row of a too-small group meets it
        out = out.join(check, groups, "left").where(F.col("_chk").isNull()).drop("_chk")
    return out


def first_k(df: DataFrame, groups: Sequence[str], k: DataFrame | Column | int | None, order: Sequence[Column],
            bucket: Column, fraction: float | None = None, rounding: str = "floor") -> DataFrame:
    """Exactly the first ``k`` rows of every group in ``order``.

    ``bucket`` (0..N_BUCKETS-1) must be monotone in ``order``.  ``k`` is a
    literal, a Column over the group keys (or a scalar subquery), or a
    DataFrame ``(groups..., k)`` (groups missing from it get no rows).
    Groups with fewer than ``k`` rows are kept whole.  Without groups the
    cut point is a scalar subquery (no join).  With ``fraction`` instead of
    ``k``, the quota ``floor``/``ceil(count * fraction)`` is taken from the
    histogram itself (no separate counting pass).
    """
    groups = list(groups)
    d = df.withColumn("_b", bucket)
    hist = d.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    if fraction is not None:
        total = F.sum("_n").over(Window.partitionBy(*groups))
        rnd = F.floor if rounding == "floor" else F.ceil
        hist = hist.withColumn("_k", rnd(total * F.lit(fraction)).cast("long"))
    elif isinstance(k, DataFrame):
        hist = hist.join(k.select(*groups, F.col("k").alias("_k")), groups)
    else:
        hist = hist.withColumn("_k", k if isinstance(k, Column) else F.lit(k))
    cw = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("_cum", F.sum("_n").over(cw))
    # Cut bucket = first bucket whose running count reaches k; a group smaller
    # than k is kept whole (cut past the last bucket); a group without quota
    # has no cut row and is dropped by the inner join below.
    reach = F.col("_cum") >= F.col("_k")
    first = F.min(F.when(reach, F.struct(F.col("_b").alias("b"),
                                         (F.col("_k") - (F.col("_cum") - F.col("_n"))).alias("need"))))
    cut = hist.groupBy(*groups).agg(first.alias("_first")).select(
        *groups, F.coalesce(F.col("_first.b"), F.lit(N_BUCKETS)).alias("_cut"), F.col("_first.need").alias("_need"))
    if groups:
        # one row per group: broadcast after a size check, so the rows are
        # never shuffled (nor skewed) by the group key
        j = join_checked(d, cut, groups)
    else:
        both = cut.select(F.struct("_cut", "_need").alias("_c")).scalar()
        j = d.withColumn("_c", both).withColumns({"_cut": F.col("_c._cut"), "_need": F.col("_c._need")}).drop("_c")
    below = j.where(F.col("_b") < F.col("_cut"))
    at_cut = j.where(F.col("_b") == F.col("_cut")).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(*order)))
    at_cut = at_cut.where(F.col("_rn") <= F.col("_need")).drop("_rn")
    return below.unionByName(at_cut).drop("_b", "_cut", "_need")


def first_k_by_hash(df: DataFrame, groups: Sequence[str], k, key: str, seed: int = SEED,
                    fraction: float | None = None, rounding: str = "floor") -> DataFrame:
    h = hash_order(key, seed)
    d = df.withColumn("_h", h)
    return first_k(d, groups, k, [F.col("_h"), F.col(key)], hash_bucket(F.col("_h")), fraction, rounding).drop("_h")


def group_quota(df: DataFrame, groups: Sequence[str], fraction: float, how: str = "floor") -> DataFrame:
    """``(groups..., k)`` with ``k = floor(count * fraction)`` (or ceil)."""
    f = F.floor if how == "floor" else F.ceil
    return df.groupBy(*groups).agg(f(F.count(F.lit(1)) * F.lit(fraction)).cast("long").alias("k"))


def sample_fraction(df: DataFrame, groups: Sequence[str], fraction: float, key: str, seed: int = SEED) -> DataFrame:
    """``int(count * p)`` rows per group (W3); the quota comes from the histogram."""
    return first_k_by_hash(df, groups, None, key, seed, fraction=fraction)


def sample_ceil(df: DataFrame, ratio: float, key: str, seed: int = SEED) -> DataFrame:
    """``ceil(count * ratio)`` rows of the whole frame (W6); the cut is a scalar subquery."""
    return first_k_by_hash(df, [], None, key, seed, fraction=ratio, rounding="ceil")


def sample_global(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Shuffle then first ``n`` (W4): the first rows by hash, in that order; only these n are sorted."""
    return first_k_by_hash(df, [], n, key, seed).orderBy(hash_order(key, seed), key)


def sample_quota(df: DataFrame, groups: Sequence[str], quotas: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Per-group quota from a dimension ``(groups..., k)`` (W2, W5)."""
    return first_k_by_hash(df, groups, quotas, key, seed)


def balanced_classes(df: DataFrame, kind_col: str, class_col: str, keep: dict, key: str) -> DataFrame:
    """Rows of each kind with the wanted class (e.g. harmful -> 1, harmless -> 0),
    every kind cut to the smallest of the counts, in key (input) order (W8, O3)."""
    wanted = [(F.col(kind_col) == kind) & (F.col(class_col) == cls) for kind, cls in keep.items()]
    cond = wanted[0]
    for c in wanted[1:]:
        cond = cond | c
    # a kind without rows counts as zero: one global aggregate, read as a scalar
    counts = [F.count_if(c) for c in wanted]
    least = F.least(*counts) if len(counts) > 1 else counts[0]
    return first_by_order(df.where(cond), [kind_col], df.agg(least.alias("k")).scalar(), key)
