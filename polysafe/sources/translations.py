"""A store of translations that is looked up without moving it (J6, X4).

The store is a table of (digest of the source text, target language,
translation), kept in buckets of (digest, language) and sorted within them.  A
request is dealt to the same buckets and merged with them in place, so the
stored texts are never exchanged, whatever the sizes; a request small enough to
be broadcast first narrows the scan to its own keys.  Translations belong to
texts, not to row numbers: equal texts share one, and a changed text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polysafe.session import cut_lineage, join_checked, ship_package

#: fn(texts, target language) -> translations; None where there is none.
Translator = Callable[[pd.Series, str], pd.Series]
KEYS = ["text_key", "language"]
#: Rows of a request from which one text is looked up apart.
HOT_ROWS = 1_000_000
_SCHEMA = "text_key binary, language string, translated string"


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def translated_rows(fn: Translator, batch_size: int = 64) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` over batches of ``text_key, language, text``, for ``mapInArrow``: one call for up to ``batch_size`` texts of one
    language; rows without a text or a language are not sent and have no result.

    Only the texts of one call are Python objects at a time, and each call's
    rows go out before the next, so a worker holds little beside an Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            language = b.column("language").to_pandas()
            wanted = language[pc.and_(b.column("text").is_valid(), b.column("language").is_valid()).to_numpy(zero_copy_only=False)]
            for lang, rows in wanted.groupby(wanted, sort=False).groups.items():
                for at in range(0, len(rows), batch_size):
                    part = b.take(pa.array(rows[at:at + batch_size]))
                    said = pa.array(list(fn(part.column("text").to_pandas(), lang)), pa.string(), from_pandas=True)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEYS), said], names=[*KEYS, "translated"])

    return run


class TranslationStore:
    """Stored translations under ``path``, in ``buckets`` buckets (fixed when the store is first written)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/buckets_{buckets}"
        self._name = "translations_" + hashlib.md5(self.path.encode()).hexdigest()
        fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(fs_path)] if fs.exists(fs_path) else []
        other = [f for f in found if f.startswith("buckets_") and f != f"buckets_{buckets}"]
        if other:
            raise ValueError(f"the store at {path} is kept in {other[0]}")
        # The files carry their bucket numbers; the session only needs to be told how they were dealt.
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name} ({_SCHEMA}) USING parquet OPTIONS (compression 'zstd') "
                  f"CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        """``text_key, language, translated``: one translation a key, should two writers have met (the least one)."""
        return self.spark.table(self._name).groupBy(*KEYS).agg(F.min("translated").alias("translated"))

    def lookup(self, wanted: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
        """``wanted`` with a column ``translated`` (null where the store has none).

        A null text or language finds nothing; columns of the store never
        clash with those of ``wanted``, but ``translated`` is replaced.  Rows
        without a text are spread by their own digest, and texts with
        ``HOT_ROWS`` rows or more (few, by their definition) take their
        translation from a side of checked size, so no task gets all rows of
        one text.  ``wanted`` is read twice: give it as a table, not as a model's output.
        """
        request = wanted.drop("translated").withColumns({"_text_key": text_digest(F.col(text_col)), "_language": F.col(language_col)})
        on = ["_text_key", "_language"]
        stored = self.table().select(F.col("text_key").alias("_text_key"), F.col("language").alias("_language"), "translated")
        hot = cut_lineage(request.where("_text_key IS NOT NULL").groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= HOT_ROWS).drop("_n"))
        found = F.col("translated")
        if not hot.isEmpty():
            hits = hot.join(stored.hint("merge"), on, "left").withColumnRenamed("translated", "_hot").withColumn("_is_hot", F.lit(True))
            request = join_checked(request, hits, on, "left")
            request = request.withColumn("_text_key", F.when(F.col("_is_hot").isNull(), F.col("_text_key"))).drop("_is_hot")
            found = F.coalesce("_hot", "translated")
        own = F.xxhash64(*[F.col(f"`{c}`") for c in wanted.columns]).cast("string").cast("binary")  # never as long as a key
        spread = request.withColumn("_text_key", F.coalesce("_text_key", own))
        return spread.join(stored.hint("merge"), on, "left").withColumn("translated", found).drop(*on, "_hot")

    def missing(self, wanted: DataFrame, id_col: str, text_col: str = "text", language_col: str = "language") -> DataFrame:
        """``row, text_key, language`` of each text and language of ``wanted`` that the store does not have.

        ``row`` is the digest of the id of one row with that text.  Only digests
        move, and equal texts are folded in the tasks first, so that a text that
        fills a third of the request is one row.
        """
        keys = wanted.where(F.col(text_col).isNotNull() & F.col(language_col).isNotNull()).select(
            F.xxhash64(id_col).alias("row"), text_digest(F.col(text_col)).alias("text_key"), F.col(language_col).alias("language"))
        firsts = keys.groupBy(*KEYS).agg(F.min("row").alias("row"))
        return firsts.join(self.spark.table(self._name).select(*KEYS).hint("merge"), KEYS, "left_anti").select("row", *KEYS)

    def add(self, rows: DataFrame) -> None:
        """Append ``text_key, language, translated``; each bucket is written by one task."""
        self._write(rows.repartition(self.buckets, *KEYS))

    def _write(self, dealt: DataFrame) -> None:
        dealt.select(*KEYS, "translated").where("translated IS NOT NULL").write.insertInto(self._name)
        self.spark.catalog.refreshTable(self._name)

    def complete(self, wanted: DataFrame, fn: Translator, id_col: str, text_col: str = "text", language_col: str = "language",
                 batch_size: int = 64) -> None:
        """Translate what is missing for ``wanted`` and add it to the store.

        Each distinct text is sent once for a language.  The write is one
        committed job: after a crash nothing of it is visible, and the next run
        asks for the same texts again.  What ``fn`` leaves null is not stored.
        """
        ship_package(self.spark)
        rows = wanted.where(F.col(text_col).isNotNull()).select(
            F.xxhash64(id_col).alias("row"), F.col(language_col).alias("language"), F.col(text_col).alias("text"))
        rows = rows.withColumn("text_key", text_digest(F.col("text")))
        todo = join_checked(rows, self.missing(wanted, id_col, text_col, language_col), ["row", *KEYS], "left_semi")
        dealt = todo.repartition(self.buckets, *KEYS).dropDuplicates(KEYS)
        self._write(dealt.select(*KEYS, "text").mapInArrow(translated_rows(fn, batch_size), _SCHEMA))

    def translate(self, wanted: DataFrame, fn: Translator, id_col: str, text_col: str = "text", language_col: str = "language",
                  batch_size: int = 64) -> DataFrame:
        """``wanted`` with ``translated``, from the store where it has it, else from ``fn`` (kept for the next time)."""
        self.complete(wanted, fn, id_col, text_col, language_col, batch_size)
        return self.lookup(wanted, text_col, language_col)
