"""Target-distribution importance resampling over hashed n-grams of words.

Every n-gram of a slice of texts is a span of one normalised buffer.  The spans
are interned in an open-addressed NumPy table: keyed by xxhash64, verified byte
by byte against the slot's first span, so that two n-grams never share a slot.
A slot holds its n-gram's bucket (worked out once a distinct n-gram) and count;
each occurrence holds its slot, and gathers the bucket's gain through it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, prepare, slices, stored, text_buffer
from polysafe.llm.numbering import numbered

BUCKETS = 10_000
#: Longest run of words that is a feature.
ORDER = 3
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Documents drawn, in a hundred.
PERCENT = 5
SEED = 42

#: Text handled at once: its n-gram arrays take some hundred bytes a word.
_SLICE = 2 << 20
_PAD = 8
#: Width of the first cut through the scores.
_COARSE = 1 << 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True

# Fixed values of the published xxhash64 algorithm.
_P1, _P2, _P3, _P4, _P5 = (U64(p) for p in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


class Words(NamedTuple):
    """The words of a slice of texts, lower-cased, each followed by one space in ``buf`` (zero-padded at the end)."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words_of(texts: pa.Array) -> Words:
    raw, offs = text_buffer(texts)
    low = _LOWER[raw]
    is_word = _WORD[low]
    opens, closes = is_word.copy(), is_word.copy()
    if len(low):
        opens[1:] &= ~is_word[:-1]
        closes[:-1] &= ~is_word[1:]
        edge = offs[(offs > 0) & (offs < len(low))]
        opens[edge] |= is_word[edge]
        closes[edge - 1] |= is_word[edge - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = last - first
    start = np.cumsum(size + 1) - size - 1
    buf = np.full(int((size + 1).sum()) + _PAD, 32, np.uint8)
    buf[len(buf) - _PAD:] = 0
    kept = np.flatnonzero(is_word)
    buf[kept + np.repeat(start - first, size)] = low[kept]
    return Words(buf, start, start + size, np.searchsorted(offs, first, side="right") - 1)


def _wide(buf: np.ndarray, kind: str) -> np.ndarray:
    """A view of the little-endian integer at every place of the padded buffer."""
    n = np.dtype(kind).itemsize
    return np.ndarray((len(buf) - n + 1,), kind, buf, strides=(1,))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U64(r)) | (x >> U64(64 - r))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """xxhash64 (seed 0) of every span; spans of 32 bytes and more one by one through the library."""
    eight, four = _wide(buf, "<u8"), _wide(buf, "<u4")
    acc = _P5 + size.astype(U64)
    short = size < 32
    for j in range(3):
        on = np.flatnonzero(short & (size >= 8 * (j + 1)))
        lane = _rotl(eight[start[on] + 8 * j] * _P2, 31) * _P1
        acc[on] = _rotl(acc[on] ^ lane, 27) * _P1 + _P4
    at = start + (size & ~7)
    on = np.flatnonzero(short & ((size & 4) > 0))
    acc[on] = _rotl(acc[on] ^ (four[at[on]].astype(U64) * _P1), 23) * _P2 + _P3
    at += size & 4
    for j in range(3):
        on = np.flatnonzero(short & ((size & 3) > j))
        acc[on] = _rotl(acc[on] ^ (buf[at[on] + j].astype(U64) * _P5), 11) * _P1
    acc ^= acc >> U64(33)
    acc *= _P2
    acc ^= acc >> U64(29)
    acc *= _P3
    acc ^= acc >> U64(32)
    long = np.flatnonzero(~short)
    if len(long):
        data = buf.tobytes()
        acc[long] = [xxhash.xxh64_intdigest(data[a:a + n]) for a, n in zip(start[long].tolist(), size[long].tolist())]
    return acc


def same_bytes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each two spans of one size hold the same bytes (eight at a time, the last eight or fewer masked)."""
    eight = _wide(buf, "<u8")
    same = np.ones(len(a), bool)
    on, at = np.arange(len(a)), 0
    while len(on):
        left = np.minimum(size[on] - at, 8)
        mask = U64(2**64 - 1) >> ((8 - left) * 8).astype(U64)
        same[on] = ((eight[a[on] + at] ^ eight[b[on] + at]) & mask) == 0
        at += 8
        on = on[same[on] & (size[on] > at)]
    return same


def intern(buf: np.ndarray, start: np.ndarray, size: np.ndarray, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(slot number of every span, index of the span that owns each slot); equal spans share a slot, others never do.

    Open addressing with linear probing, all spans a step at a time: a span at
    an empty place claims it (of several the last writer owns it), a span whose
    place is owned by equal bytes is done, all others go on to the next place.
    """
    keys = xxh64(buf, start, size) if keys is None else keys
    room = 1 << max(3, int(2 * len(start)).bit_length())
    owner = np.full(room, -1, np.int64)
    slot = np.zeros(len(start), np.int64)
    todo, at = np.arange(len(start)), (keys & U64(room - 1)).astype(np.int64)
    while len(todo):
        free = owner[at] < 0
        owner[at[free]] = todo[free]
        own = owner[at]
        fits = (keys[own] == keys[todo]) & (size[own] == size[todo])
        check = np.flatnonzero(fits & (own != todo))
        fits[check] = same_bytes(buf, start[own[check]], start[todo[check]], size[todo[check]])
        slot[todo[fits]] = at[fits]
        todo, at = todo[~fits], (at[~fits] + 1) & (room - 1)
    taken = np.flatnonzero(owner >= 0)
    number = np.zeros(room, np.int64)
    number[taken] = np.arange(len(taken))
    return number[slot], owner[taken]


def crc32(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of every span; spans over 64 bytes one by one through the library."""
    order = np.argsort(-size, kind="stable")
    a, n = start[order], size[order]
    many = int(np.searchsorted(-n, -64, side="left"))  # those longer than 64 bytes come first
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for j in range(int(n[many]) if many < len(n) else 0):
        on = slice(many, int(np.searchsorted(-n, -j, side="left")))
        c = crc[on]
        crc[on] = _CRC[(c ^ buf[a[on] + j]) & np.uint32(255)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    if many:
        data = buf.tobytes()
        crc[:many] = [zlib.crc32(data[s:s + m]) for s, m in zip(a[:many].tolist(), n[:many].tolist())]
    out = np.empty(len(n), np.uint32)
    out[order] = crc
    return out


class Table(NamedTuple):
    """The distinct n-grams of one length in a slice: bucket and count of each slot; document and slot of each occurrence."""

    bucket: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    slot: np.ndarray


def tables(words: Words, buckets: int = BUCKETS, order: int = ORDER) -> Iterator[Table]:
    """One table for the n-grams of each length from 1 to ``order``; n-grams never cross documents."""
    for n in range(1, order + 1):
        m = len(words.start) - n + 1
        if m <= 0:
            return
        on = np.flatnonzero(words.doc[:m] == words.doc[n - 1:])
        start = words.start[on]
        size = words.end[on + n - 1] - start
        slot, owner = intern(words.buf, start, size)
        bucket = (crc32(words.buf, start[owner], size[owner]) % np.uint32(buckets)).astype(np.int64)
        yield Table(bucket, np.bincount(slot, minlength=len(owner)), words.doc[on], slot)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features of all texts by bucket; a task sends one row a bucket, so what is moved does not grow with the texts."""
    prepare(texts.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in slices(batches, "text", _SLICE):
            for t in tables(words_of(b.column("text")), buckets, order):
                total += np.bincount(t.bucket, weights=t.count, minlength=buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, np.int64)
    for r in found:
        total[r.bucket] = r.n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    ratio = ((t + 1) * (s.sum() + len(s))) / ((s + 1) * (t.sum() + len(t)))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``<id>, n_words, n_features, weight`` of every row: the sum of the gains of its features."""
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(gain)  # one number a bucket
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in slices(batches, "text", _SLICE):
            words = words_of(b.column("text"))
            n_words = np.bincount(words.doc, minlength=b.num_rows).astype(np.int64)
            n_features = np.zeros(b.num_rows, np.int64)
            weight = np.zeros(b.num_rows, np.int64)
            for t in tables(words, len(gain), order):
                n_features += np.bincount(t.doc, minlength=b.num_rows)
                ends = np.cumsum(np.concatenate(([0], gain[t.bucket][t.slot])))
                bounds = np.searchsorted(t.doc, np.arange(b.num_rows + 1))
                weight += ends[bounds[1:]] - ends[bounds[:-1]]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n_words), pa.array(n_features), pa.array(weight)],
                                             names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def noise(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate, rounded down, from a digest of seed and key; a null key counts as empty text."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(2.0**32)))).cast("long")


def highest(scored: DataFrame, score: str, n: int) -> int | None:
    """The ``n``-th highest score (ties counted one by one); None if there are not so many or ``n`` is 0.

    Exact, by refinement: a histogram of wide ranges finds the range of the
    cut, one of single scores in that range the cut; what is sorted is as long
    as the histogram, never as the table.
    """
    bound, above, width = scored, 0, _COARSE
    if n <= 0:
        return None
    while True:
        at = F.expr(f"floor(`{score}` / {width})")
        steps = bound.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
        total = F.expr("sum(n) OVER (ORDER BY at DESC ROWS UNBOUNDED PRECEDING)")
        hit = steps.select("at", "n", total.alias("to")).where(F.col("to") >= n - above).orderBy(F.col("at").desc()).first()
        if hit is None:
            return None
        if width == 1:
            return int(hit["at"])
        bound, above, width = scored.where(at == hit["at"]), above + hit["to"] - hit["n"], 1


def draw(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Adds ``score`` and ``rank``: the highest ``percent`` in a hundred of the rows of ``least_words`` words, the rest null.

    Ties go to the smaller id (a null id first), then to the smaller row.  Only
    rows that reach the lowest drawn score are sorted.
    """
    scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "resample")
    able = scored.where(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    cut = highest(able, "score", wanted)
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    reaches = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    placed = numbered(scored.where(reaches), [F.col("score").desc(), F.col(id_col)], name="place")
    rank = F.when(F.col("place") < wanted, F.col("place") + 1)
    return placed.select(*scored.columns, rank.alias("rank")).unionByName(scored.where(~reaches).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS,
             order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Every row's ``<id>, n_words, n_features, weight, score, rank`` for a draw that follows the texts of ``target``.

    Bucket counts cover all texts of both tables; texts are read twice, whole,
    and never moved.  Null and empty text have no features and weight 0; they
    are not drawn while ``least_words`` is above 0.  Rows of one id share their
    noise and are judged by their own text; repeated rows are drawn one by one.
    An empty target gives every bucket the same smoothed share; an empty table
    gives no rows; other columns, whatever their names, are ignored.
    """
    gain = gains(bucket_counts(docs, text_col, buckets, order), bucket_counts(target, text_col, buckets, order))
    return draw(weigh(docs, gain, id_col, text_col, order), percent, least_words, id_col, seed)
