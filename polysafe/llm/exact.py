"""Exact duplicates by skew-safe combining (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import cut

#: Salts a digest group is dealt to before its winners meet.
SALTS = 64


def normalised(text: Column) -> Column:
    """Every run of space, tab, line or page break as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256,
) -> DataFrame:
    """One row per input row: ``<id>, keep_id, group_size, kept, digest``.

    1. Deduplicate locally: the map side of the first aggregation keeps one row
       per (digest, salt, content) and task.
    2. Merge salted digest groups, the whole content being part of the key.
    3. Combine the salts' winners globally, again by digest and content.

    The salt comes from the row id, so a group holding a third of all rows is
    spread over ``salts`` tasks and reaches the last step as ``salts`` rows.
    Rows find their winner again by digest; a digest shared by different
    contents is recognised in step 3 and its rows are matched by content.

    Null text counts as empty; a null id is kept as a row, never as a
    ``keep_id`` beside other ids; repeated rows count each, and all rows that
    carry the kept id are kept; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).withColumn("_digest", digest(F.col("_norm")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)))
    local = salted.groupBy("_digest", "_salt", "_norm").agg(F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    merged = local.groupBy("_digest", "_norm").agg(F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"))
    winners = cut(
        merged.groupBy("_digest").agg(
            F.min("_keep").alias("_keep"), F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_contents")
        )
    )
    ids = rows.select("_id", "_digest")
    out = ids.join(winners.where("_contents = 1").drop("_contents"), "_digest")
    clashes = winners.where("_contents > 1").select("_digest")
    if not clashes.isEmpty():
        whole = rows.join(clashes, "_digest", "left_semi")
        out = out.unionByName(
            whole.join(merged.join(clashes, "_digest", "left_semi"), ["_digest", "_norm"]).drop("_norm")
        )
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_digest").alias("digest"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    A row stays if it has the id that its own text's group keeps: of rows that
    share an id, those whose text has a smaller id elsewhere go.  Rows equal
    in id and text stay together; so do rows without an id whose text no other
    row has.
    """
    kept = duplicate_groups(docs, id_col, text_col, salts).where("kept")
    keep = kept.select(F.col(id_col).alias("_kept_id"), F.col("digest").alias("_kept_digest")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (sha256(normalised(F.col(text_col))) == F.col("_kept_digest"))
    return docs.join(keep, same, "left_semi")
