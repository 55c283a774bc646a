"""Rows that share an id, for operators that know documents by a long id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import stored
from polysafe.llm.numbering import numbered


#: Where ids repeat, a row's number is that of its id's first row, then so many bits for its place among them.
PLACE_BITS = 31


def each_row(source: DataFrame, work: Callable[[DataFrame, int], DataFrame], ids: Sequence[str] = ("id",)) -> DataFrame:
    """``work`` on ``source`` (``id`` long, not null, and ``text``), with every row a document of its own.

    Where no id repeats, ``work`` gets the rows as they are, and 0.  Else it
    gets the distinct (id, text) under numbers in the order of id, then of the
    text's digest, and ``PLACE_BITS``: numbers that differ above these bits
    have different ids.  Rows equal in both are one document and get its
    result each.  The columns ``ids`` of the result, the row's own ``id`` among
    them, are numbers and turned back into ids.
    """
    if source.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return work(source, 0)
    keyed = source.withColumn("_digest", F.unhex(F.sha2("text", 256)))
    places = stored(numbered(keyed.select("id", "_digest").distinct(), [F.col("id"), F.col("_digest")], name="_place"), "places")
    firsts = places.groupBy("id").agg(F.min("_place").alias("_first"))
    number = F.shiftleft("_first", PLACE_BITS) + F.col("_place") - F.col("_first")
    numbers = stored(places.join(firsts, "id").select("id", "_digest", number.alias("_row")), "rows")
    texts = keyed.groupBy("id", "_digest").agg(F.first("text").alias("text"))
    out = stored(work(texts.join(numbers, ["id", "_digest"]).select(F.col("_row").alias("id"), "text"), PLACE_BITS), "by-row")
    for c in ids:
        if c != "id":
            names = numbers.select(F.col("_row").alias(c), F.col("id").alias("_named"))
            out = out.join(names, c, "left").withColumn(c, F.col("_named")).drop("_named")
    rows = keyed.select("id", "_digest").join(numbers, ["id", "_digest"])
    return rows.join(out.withColumnRenamed("id", "_row"), "_row").drop("_row", "_digest")
