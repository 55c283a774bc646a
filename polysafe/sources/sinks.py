"""Sinks: partitioned tables, nested score JSON, per-language increments, metrics.

Writes are distributed (one file per task), idempotent by ``mode``, and
partitioned by the run attributes so later reads prune directories.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from polysafe.sources.readers import SCORE_JSON_TYPE


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("escape", '"')
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_language(df: DataFrame, path: str, language_col: str = "language") -> None:
    """Per-language increment: adds only the new rows, under ``language=...`` of a folder of their own."""
    write_increment(df, path, [language_col])


def nested_json(long: DataFrame, keys: Sequence[str], outer: str, inner: str, value: str) -> DataFrame:
    """Long cells -> one JSON document ``{outer: {inner: value}}`` per key tuple.

    Lists are collected per (keys, outer) and per keys only: their length is
    bounded by the response-language and language dimensions.
    """
    keys = list(keys)
    per_outer = long.groupBy(*keys, outer).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(inner), F.col(value)))).alias("_m"))
    return per_outer.groupBy(*keys).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(outer), F.col("_m"))))).alias("json"))


def parse_nested_json(df: DataFrame, keys: Sequence[str], json_col: str = "json") -> DataFrame:
    m = df.select(*keys, F.from_json(F.col(json_col), SCORE_JSON_TYPE).alias("_m"))
    outer = m.select(*keys, F.explode("_m").alias("language", "_inner"))
    return outer.select(*keys, "language", F.explode("_inner").alias("language_response", "value"))


def write_nested_json(df: DataFrame, path: str, keys: Sequence[str], json_col: str = "json") -> None:
    """One text file per key combination (``key=value`` directories), content = the JSON document."""
    df.select(*keys, json_col).write.mode("overwrite").partitionBy(*keys).text(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


#: Marks an increment as whole; written after everything else in its folder.
FINISHED = "_finished"


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_increment(df: DataFrame, path: str, partition_by: Sequence[str], files: int = 8) -> None:
    """Add rows to a table as a folder ``increment=...`` that counts only once its marker is there.

    A run that dies at any moment leaves a folder without the marker, which no
    reader sees, and the next run writes its rows anew under another name.
    Rows are dealt to up to ``files`` tasks a partition by their content, so a
    partition that holds a third of them is written by several tasks.
    """
    spark, target = df.sparkSession, f"{path}/increment={uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    dealt = df.withColumn("_file", part).repartition(*partition_by, "_file").drop("_file")
    dealt.write.partitionBy(*partition_by).parquet(target)
    marker, fs = _folder(spark, f"{target}/{FINISHED}")
    fs.create(marker).close()


def read_increments(spark: SparkSession, path: str, partition_by: Sequence[str]) -> DataFrame | None:
    """All finished increments of a table, partition columns as the text they were written as; None where there is none."""
    root, fs = _folder(spark, path)
    if not fs.exists(root):
        return None
    folders = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("increment=")]
    whole = sorted(f.toString() for f in folders if fs.exists(_folder(spark, f"{f.toString()}/{FINISHED}")[0]))
    if not whole:
        return None
    reader = spark.read.option("basePath", root.toString())
    data = [f for f in reader.parquet(*whole).schema if f.name not in (*partition_by, "increment")]
    schema = StructType([*data, *(StructField(c, StringType()) for c in ("increment", *partition_by))])  # no guessing: 007 stays 007
    return reader.schema(schema).parquet(*whole).drop("increment")
