"""Shared helpers: shipping code, checkpoints, and vectorised text primitives.

The numpy helpers work on Arrow string columns through their raw UTF-8 buffers,
a few megabytes of text at a time, so memory in a task is bounded by the slice
size plus the longest single document.
"""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from polysafe.session import checkpoint_dir, ship_package, table_path

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers and make sure a checkpoint folder is set."""
    ship_package(spark)
    checkpoint_dir(spark)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(rows: int, least: int) -> int:
    """Partitions of ``least`` rows at least, for ``coalesce``: a small table is not strewn over as many files as there are shuffle partitions."""
    return max(1, -(-rows // least))


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if wide else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    o = np.frombuffer(offs, kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0]:o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds at most ``limit`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word ``[^\\x20\\x09-\\x0D]+``; words never cross documents."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_WS[buf]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first[edge] |= word[edge]
    last[edge - 1] |= word[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, lane: int = 0) -> np.ndarray:
    """64-bit hash of each byte span (spans are disjoint, ascending and not empty)."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)[:-1]))
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(at, size)
    byte = buf[within + np.repeat(start, size)]
    if lower:
        byte = _LOWER[byte]
    val = (byte.astype(U64) + U64(1)) * powers(_BASES[lane], int(size.max()))[within]
    return mix(np.add.reduceat(val, at) + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def windows_hash(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """Hash of every ``n`` consecutive values (length ``len(h) - n + 1``); order matters."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    base = _BASES[lane] | U64(1)
    acc = np.zeros(m, U64)
    for j in range(n):
        acc *= base
        acc += h[j:j + m]
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 bits as int64, Spark's long."""
    return x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)


def stored(df: DataFrame, name: str, free: bool = True) -> DataFrame:
    """Written once as a compressed table in the shared checkpoint folder and read back (cuts lineage).

    Unlike a checkpoint the table is columnar, so later jobs read only the columns they need.
    The shuffle files behind it are needed no more and, unless ``free`` is
    false, are let go at once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if free:
        release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a table from ``stored`` that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, in buckets of ``key``: later joins on it do not move the table again.

    A session keeps the number of buckets only with a catalogue entry, which
    is needed while the table is looked up and is dropped at once; the files stay.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{table}"
    df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(shuffle_parts(spark), key).sortBy(key).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Free the disk of finished shuffles.

    Spark deletes a shuffle's files when the driver's garbage collector finds
    its plan unreachable, else only every ``spark.cleaner.periodicGC.interval``
    (30 minutes), which lets a query of several jobs pile up all of them.
    The first collection frees what holds a plan, the second the plan.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
