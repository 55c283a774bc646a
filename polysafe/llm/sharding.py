"""Weighted shards by rendezvous hashing of stable record keys (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.numbering import numbered

#: Shards of equal weight that the registered query fills.
SHARDS = (1.0,) * 8
SEED = 17


def _digits(label: str, key: Column, seed: int, n: int) -> Column:
    """``n`` hex digits (52 bits for 13) of the digest of a label and a key, as a number."""
    said = F.concat(F.lit(f"{label}:{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, n), 16, 10).cast("long")


def bids(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """Array of ``struct<bid, shard>``: what each shard bids for a key, w / -ln(u) with u uniform by key and shard.

    A shard's bid depends on the key, its number and its weight alone, so
    another shard, or another weight of one shard, changes no other bid: rows
    move only into a shard that is new or heavier, or out of one that is lighter.
    """
    if not weights or any(not 0 < w < float("inf") for w in weights):
        raise ValueError("weights must be positive numbers, one a shard")
    u = [(_digits(f"shard {s}", key, seed, 13) + F.lit(0.5)) / F.lit(2.0**52) for s in range(len(weights))]
    return F.array(*[F.struct((F.lit(float(w)) / -F.log(x)).alias("bid"), F.lit(s).alias("shard")) for s, (w, x) in enumerate(zip(weights, u))])


def shard_of(key: Column, weights: Sequence[float] = SHARDS, seed: int = SEED) -> Column:
    """The shard with the highest bid for a key; a null key bids as the empty text."""
    return F.array_max(bids(key, weights, seed))["shard"]


def assign(docs: DataFrame, weights: Sequence[float] = SHARDS, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``docs`` with a column ``shard`` (in place of one of that name): a projection, nothing moves."""
    return docs.withColumn("shard", shard_of(F.col(id_col), weights, seed))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = SHARDS, id_col: str = "doc_id", files: int = 16, seed: int = SEED) -> None:
    """``docs`` as Parquet, a folder a shard with up to ``files`` files, each written by a task of its own.

    Rows are dealt to a shard's files by all their columns, so many rows under one id do not meet in one task.
    """
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    out = assign(docs.withColumn("_file", part), weights, id_col, seed)
    out.repartition(len(weights) * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)


def place(docs: DataFrame, weights: Sequence[float] = SHARDS, grown: float = 1.0, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Every row's shard and its place there, and its shard with one more of weight ``grown``.

    Returns ``<id>, size, text_crc32, law, shard, slot, grown_shard``.  Slots
    are gapless from 0 in each shard, in the order of a digest of the key (then
    id, size, checksum), so that a shard is read in a mixed order that no other
    row's presence turns round.  The text is read once; what is numbered is a
    narrow row.

    Null and empty text have size 1 and checksum 0.  All rows of one id, and
    all rows without an id (as if the id were the empty text), share a shard:
    that is the law.  Repeated rows get a slot each.  An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    offers = docs.select(
        key.alias("_id"), (F.octet_length(text).cast("long") + 1).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"),
        _digits("slot", key, seed, 15).alias("_mixed"), bids(key, [*weights, grown], seed).alias("_bids"))
    rows = offers.select(
        "_id", "_size", "_crc", "_mixed",
        F.array_max(F.slice("_bids", 1, len(weights)))["shard"].alias("_shard"), F.array_max("_bids")["shard"].alias("_grown"))
    order = [F.col("_mixed"), F.col("_id"), F.col("_size"), F.col("_crc")]
    return numbered(rows, order, ["_shard"], "slot").select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("key").alias("law"),
        F.col("_shard").alias("shard"), "slot", F.col("_grown").alias("grown_shard"))
