"""Spark session construction and lineage cutting.

The session is configured for AQE (runtime coalescing, skew-join splitting and
broadcast conversion) and Arrow batches for the few Python boundaries.  The UI
is off.  ``spark.checkpoint.dir`` is read from the session; a private scratch
directory is only set when the cluster did not name one (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(
    master: str | None = None,
    app_name: str = "polysafe",
    shuffle_partitions: int | None = None,
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Only a local master may leave ``spark.checkpoint.dir`` unset: then a fresh
    scratch folder is created.  On a cluster each machine would write to a
    disk of its own, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    active = sc._jsc.sc().getCheckpointDir()
    if active.isDefined():
        return active.get()
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="polysafe-ckpt-")
    sc.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``polysafe`` importable on every Python worker (once per context).

    Python UDFs and ``mapInPandas`` functions are pickled by reference to this
    package, so executors need the code; it travels as a zip via ``addPyFile``.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="polysafe-pkg-"), "polysafe.zip")
    with zipfile.ZipFile(out, "w") as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def ensure_parallel(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a table that arrives as one single split.

    A small table written as one row group is read by one task; before
    CPU-heavy work on whole texts it is dealt to ``defaultParallelism``
    partitions.  Anything with two splits or more is left alone: a large
    table is never moved for the sake of idle cores.
    """
    if df.rdd.getNumPartitions() > 1:
        return df
    return df.repartition(min_partitions or df.sparkSession.sparkContext.defaultParallelism)


def join_checked(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int | None = None) -> DataFrame:
    """Join against a derived side whose size is checked, not assumed.

    The side (one row per group, per winner, ...) is materialised first
    (reliable checkpoint) and measured; within ``max_bytes`` (by default the
    session's broadcast threshold) it is broadcast, so the big side is neither
    shuffled nor skewed by the join key; beyond it the join is left to a
    regular shuffle join.
    """
    from pyspark.sql import functions as F

    small = cut_lineage(small)
    if max_bytes is None:
        max_bytes = small.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = small.agg(F.sum(F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in small.columns]))))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= max_bytes else small, on, how)
