"""Parquet table access for the driver tables (``{sf_dir}/{name}.parquet``).

Columns are selected right at the scan so that Parquet column pruning and
filter pushdown apply; nothing downstream ever sees unused columns.

The file listing and footer/schema read of a table happen once per session:
the relation is kept and re-projected for every query (listing a 100 TB
table is itself a distributed job worth doing once).  ``refresh_tables``
forgets them after files change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polysafe.session import table_path

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

_RELATIONS: dict[tuple[str, str, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    path = table_path(sf_dir, name)
    key = (spark.sparkContext.applicationId, spark._jsparkSession.sessionUUID(), path)
    df = _RELATIONS.get(key)
    if df is None:
        df = _RELATIONS[key] = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def refresh_tables() -> None:
    _RELATIONS.clear()
