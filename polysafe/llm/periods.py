"""Periodic runs of words inside a document: seeds on diagonals, extended once each.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(MIN_WORDS, MIN_PERIODS * q)`` words long, that no
neighbouring word extends keeping the period.

Words q apart agree at all but the last q places of a run, so the places of a
run agree with those q later over at least ``max(MIN_WORDS, 3 q) - q`` words in
a row: at least 16 for every q, and at least 2 q.  Periods are therefore taken
in bands (up to 16, 17 to 32, 33 to 64, ...) and each band has an index of the
k-grams of the overlap it guarantees, k being its longest period.  Since k >= q,
two occurrences of a run's k-gram less than q apart would give the run a
shorter period, so within a run the *next* occurrence of the k-gram at a place
is exactly q later: only neighbouring occurrences are paired, never all pairs,
and a place has one pair a band.  A pair is a seed on the diagonal of its lag.
Seeds are extended word by word both ways; a table of the furthest place covered
on each lag keeps a diagonal's other seeds from being extended again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import prepare, slices, text_buffer, word_spans

MIN_WORDS = 24
MIN_PERIODS = 3
#: Least overlap of a run with itself one period later: min over q of max(24, 3 q) - q, reached at q = 8.
FIRST_BAND = 16

_STEP = 256


def word_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    if not len(start):
        return np.zeros(0, np.int64)
    size = end - start
    at = np.concatenate(([0], np.cumsum(size)))
    take = np.arange(at[-1], dtype=np.int64) + np.repeat(start - at[:-1], size)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(buf[take])])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _name(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose key is not the only one, a dense number for the key of each)."""
    _, name, n = np.unique(keys, return_inverse=True, return_counts=True)
    many = n[name] > 1
    return places[many], name[many]


def seeds(ids: np.ndarray, doc: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, lag) of the neighbouring occurrences of equal k-grams in one document, a band of lags at a time.

    ``ids`` are the words of several documents in a row, ``doc`` each word's
    document and ``stop`` the end of that document.  The k-grams of a band
    are named by pairs of the names of half the length (exact, no hashes), and
    places whose half is unique in its document are left out of all longer ones.
    """
    if not len(ids):
        return
    place, name = _name(doc * (int(ids.max()) + 1) + ids, np.arange(len(ids)))
    names = np.full(len(ids), -1, np.int64)
    k = 1
    while len(place):
        if k >= FIRST_BAND:
            order = np.argsort(name, kind="stable")
            here, there = place[order][:-1], place[order][1:]
            lag = there - here
            near = (name[order][:-1] == name[order][1:]) & (lag <= k) & (lag > (0 if k == FIRST_BAND else k // 2))
            yield here[near], lag[near]
        names[place] = name
        fits = place[place + 2 * k <= stop[place]]
        fits = fits[names[fits + k] >= 0]
        keys = names[fits] * (int(name.max()) + 1) + names[fits + k]
        names[place] = -1
        place, name = _name(keys, fits)
        k *= 2


def _agree(ids: np.ndarray, at: int, lag: int, bound: int, step: int) -> int:
    """How many places in a row agree with those ``lag`` later, from ``at`` upwards (step 1) or downwards (-1) to ``bound``."""
    done, block = 0, _STEP
    room = bound - at if step > 0 else at - bound + 1
    while done < room:
        n = min(block, room - done)
        lo = at + done if step > 0 else at - done - n + 1
        bad = np.flatnonzero(ids[lo:lo + n] != ids[lo + lag:lo + lag + n])
        if len(bad):
            return done + int(bad[0] if step > 0 else n - 1 - bad[-1])
        done, block = done + n, block * 2
    return done


def runs_of(ids: np.ndarray, doc: np.ndarray, first: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period) of every run, by document, start and period; starts count from the document's first word."""
    out = []
    for place, lag in seeds(ids, doc, stop):
        order = np.lexsort((place, lag, doc[place]))
        place, lag = place[order], lag[order]
        head = np.ones(len(place), bool)
        head[1:] = (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1])
        covered: dict[int, int] = {}
        for i, q in zip(place[head].tolist(), lag[head].tolist()):
            lo, hi = int(first[i]), int(stop[i])
            if i < covered.get(q, 0):
                continue
            right = i + _agree(ids, i, q, hi - q, 1)
            covered[q] = right
            start = i - _agree(ids, i - 1, q, lo, -1)
            length = right + q - start
            if length >= max(MIN_WORDS, MIN_PERIODS * q):
                out.append((int(doc[i]), start - lo, length, q))
    return sorted(out)


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a run after that run's first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, n_words, runs, collapsed`` of every row, each whole text being one sequence of words.

    ``runs`` is an array of ``struct<start, length, period>`` by start, then
    period, in words from 0; ``collapsed`` is the text without the words that
    lie in a run after its first period, joined by one space.

    A row is judged by itself and nothing is moved, so hot sources, copies and
    repeated or null ids need no care.  Null and empty text have no words, no
    runs and an empty ``collapsed``.  Memory is a few numbers a word of the
    longest text or of a slice of texts, whichever is more; time is
    n log n in its words.  An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            start, end, doc = word_spans(buf, offs)
            n = np.bincount(doc, minlength=b.num_rows)
            ends = np.cumsum(n)
            first, stop = np.repeat(ends - n, n), np.repeat(ends, n)
            runs: list[list] = [[] for _ in range(b.num_rows)]
            for d, *run in runs_of(word_ids(buf, start, end), doc, first, stop):
                runs[d].append(tuple(run))
            gone = np.zeros(len(start), bool)
            for d, found in enumerate(runs):
                if found:
                    gone[ends[d] - n[d]:ends[d]] = dropped(found, int(n[d]))
            yield pa.RecordBatch.from_arrays([
                b.column("id"), pa.array(n.astype(np.int64)),
                pa.array([[dict(zip(("start", "length", "period"), r)) for r in found] for found in runs], run_type),
                joined(buf, start[~gone], end[~gone], doc[~gone], b.num_rows)], names=["id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)


def joined(buf: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
    """Each row's words joined by one space."""
    size = end - start
    last = np.ones(len(size), bool)
    last[:-1] = doc[1:] != doc[:-1]
    room = size + ~last
    at = np.concatenate(([0], np.cumsum(room)))
    out = np.full(at[-1], 32, np.uint8)
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(np.cumsum(size) - size, size)
    out[within + np.repeat(at[:-1], size)] = buf[within + np.repeat(start, size)]
    bounds = at[np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=rows))))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]).cast(pa.large_string()).cast(pa.string())


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The output of ``periodic_runs`` as counts, the run repeated most often, and digests.

    Returns ``<id>, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256``.  The run is that of the greatest length / period,
    compared as fractions; ties go to the least start, then period.
    """
    def better(a: Column, b: Column) -> Column:
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    top = F.aggregate("runs", F.get("runs", F.lit(0)), better)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", top)
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(_best.length * 1000) div _best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
