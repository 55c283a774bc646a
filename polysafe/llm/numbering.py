"""Gapless numbers in a stated order, without one task that sees all rows (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.llm.common import stored

#: Equal rows written out at once.
_CHUNK = 4096


def numbered(rows: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "position") -> DataFrame:
    """``rows`` with a column ``name``: 0, 1, 2 ... by ``order`` within each ``group`` (columns without nulls).

    Rows that are equal in all columns are folded into one with a count before
    anything is sorted, so a row that makes up a third of the table is one row
    here; they are written out again, a number each, at the end.  The folded
    rows are dealt to ranges of (group, order), and each range's first number
    is the running sum of the counts before it: one small row per range and
    group.  The ranges are a written table, so that a lost task meets the same
    ones.  Rows that tie in ``order`` but differ elsewhere are numbered by
    their other columns.  An empty table gives an empty one.
    """
    spark, columns = rows.sparkSession, rows.columns
    rest = [F.col(f"`{c}`") for c in columns]
    by = [*(F.col(g) for g in group), *order, *rest]
    folded = rows.groupBy(*rest).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stored(folded.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("_range", *group).agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("_range", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_range", *group).orderBy(*order, *rest).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(firsts, ["_range", *group]).withColumn("_at", F.col("_first") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    chunks = placed.withColumn("_chunk", F.explode(F.expr(f"sequence(0, (_n - 1) div {_CHUNK})")))
    one_each = chunks.withColumn("_copy", F.explode(F.expr(f"sequence(_chunk * {_CHUNK}, least(_chunk * {_CHUNK} + {_CHUNK - 1}, _n - 1))")))
    return one_each.select(*rest, (F.col("_at") + F.col("_copy")).alias(name))
