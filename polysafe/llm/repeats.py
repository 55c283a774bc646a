"""Windows of fixed length that occur earlier: the Spark side shared by the two substring operators.

Each operator chooses anchors: places in a text picked from nearby content
alone, such that every window has exactly one anchor and equal windows have
it at the same offset.  An anchor stands for the run of window starts it
serves and carries two fingerprints: ``key``, content that every such
window has around the anchor, and ``cls``, all content that these windows cover.

1. Anchors meet by key.  Anchors of one class have the same windows, so all
   but the first are decided at once; copies cost a row per anchor and no pairs.
2. Only the first of each class, and only under keys with several classes
   (the ends of repeated passages), are refined: their windows are split into
   a few groups by place, each with a key and a class of its own.
3. What is still undecided is refined to single windows.

Fingerprints that decide have 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, mix, prepare, shuffle_parts, signed, slices, stored, stored_by

#: A null id stands for itself under this number.
NULL_ID = -(2**63)

#: Text handled at once: its 64-bit arrays should stay in a core's cache.
_SLICE = 1 << 20

_rng = np.random.default_rng(20240229)
#: Random value of each byte, and an odd base, for the two fingerprint lanes.
BYTE_VALUES = _rng.integers(0, 2**64, size=(2, 256), dtype=U64)
BASES = _rng.integers(0, 2**64, size=2, dtype=U64) | U64(1)

#: Windows of a group between an anchor and single windows; half a window at most, so that a group's windows share words.
GROUP = 6

#: texts -> (row, first window start, run, key, cls); see ``run_of``
Anchors = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: texts -> function (row, start, end, lane) -> fingerprints of spans inside texts
Spans = Callable[[pa.Array], Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]]


def run_of(n: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Number of window starts and distance from the first one to the anchor, in one number (both below 2^15)."""
    return n | reach << 16


class Prefix:
    """Fingerprints of any span of a sequence from prefix sums of value * base^place (mod 2^64)."""

    def __init__(self, values: np.ndarray, lane: int):
        up = np.full(len(values) + 1, BASES[lane], U64)
        up[0] = 1
        np.multiply.accumulate(up, out=up)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])
        down = np.full(len(values) + 1, U64(pow(int(BASES[lane]), -1, 2**64)), U64)
        down[0] = 1
        self.down = np.multiply.accumulate(down, out=down)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def every(self, n: int) -> np.ndarray:
        """Of all spans of length n."""
        return (self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n]


def later(rows: DataFrame, same_document: bool, shift: int = 0) -> DataFrame:
    """``id, lo, run, refine``: rows whose class began earlier, and the first of classes that share their key.

    ``rows`` has ``key, cls, id, lo, run``; those with a negative run are decided
    already (``settle``) and passed on.  Earlier is a smaller id (above its
    lowest ``shift`` bits) or, with ``same_document``, the same id and a smaller place.  Rows stream by in
    order; what is held back is at most one document's share of one key.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, class and first row of the class at the end of the last batch
        several = False  # the last key already has several classes
        held: list[np.ndarray] = []
        for b in batches:
            if not b.num_rows:
                continue
            key, cls, ids, lo, run = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if (known := run < 0).any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[known]), pa.array(lo[known]), pa.array(~run[known]), pa.array(np.zeros(int(known.sum()), bool))], names=["id", "lo", "run", "refine"])
                key, cls, ids, lo, run = (c[~known] for c in (key, cls, ids, lo, run))
                if not len(key):
                    continue
            new_key, new_cls = np.ones(len(key), bool), np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_cls[1:] = new_key[1:] | (cls[1:] != cls[:-1])
            goes_on = last is not None and key[0] == last[0]
            new_key[0] = not goes_on
            new_cls[0] = not goes_on or cls[0] != last[1]
            at = np.maximum.accumulate(np.where(new_cls, np.arange(len(key)), -1))
            first_id, first_lo = np.where(at < 0, last[2] if last else 0, ids[at]), np.where(at < 0, last[3] if last else 0, lo[at])
            after = (ids >> shift > first_id >> shift) | ((lo > first_lo) if same_document else False)
            group = np.cumsum(new_key) - int(not goes_on)  # 0 goes on from the last batch or begins with this one
            classes = np.bincount(group, new_cls)
            if goes_on:
                classes[0] += 2 if several else 1
            multi = classes >= 2
            first = ~after
            open_ = group == group[-1]
            out = after | (first & multi[group])
            rows = np.stack([ids, lo.astype(np.int64), run.astype(np.int64), first.astype(np.int64)], axis=1)
            parts = [rows[out]]
            if goes_on and multi[0]:
                parts += held
            if not (goes_on and group[-1] == 0):
                held = []
            held = [] if multi[-1] else [*held, rows[first & open_]]
            several = bool(multi[-1])
            last = (key[-1], cls[-1], first_id[-1], first_lo[-1])
            rows = np.concatenate(parts)
            if len(rows):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[:, 0]), pa.array(rows[:, 1].astype(np.int32)), pa.array(rows[:, 2].astype(np.int32)), pa.array(rows[:, 3] == 1)],
                    names=["id", "lo", "run", "refine"])

    placed = rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "cls", "id", "lo")
    return placed.mapInArrow(stream, "id long, lo int, run int, refine boolean")


def settle(key, cls, ids, lo, run, same_document: bool, shift: int = 0):
    """The rows, in order; those that come after one of their class here are decided (run turned negative) and dealt out evenly.

    A common passage thus sends a row or two from each slice of text to the task of its key.
    """
    order = np.lexsort((lo, ids, cls, key))
    key, cls, ids, lo, run = (c[order] for c in (key, cls, ids, lo, run))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    after = (ids >> shift > ids[first] >> shift) | ((lo > lo[first]) if same_document else False)
    apart = mix(ids.astype(U64) ^ mix(lo.astype(U64)))
    return np.where(after, apart, key.astype(U64)), cls, ids, lo, np.where(after, ~run, run)


def repeated(docs: DataFrame, anchors: Anchors, spans: Spans, window: int, same_document: bool, shift: int = 0) -> DataFrame:
    """``id, text, spans``: each document with repeated windows, and the runs (lo, run) of their starts.

    ``docs`` has ``id`` (long, not null, each once: see ``rows.each_row``) and ``text``.
    """
    prepare(docs.sparkSession)
    schema = "key long, cls long, id long, lo int, run int"

    def batch(key, cls, ids, lo, run) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(signed(key)), pa.array(signed(cls)), pa.array(ids), pa.array(lo.astype(np.int32)), pa.array(run.astype(np.int32))],
            names=["key", "cls", "id", "lo", "run"])

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            row, lo, run, key, cls = anchors(b.column("text"))
            if len(row):
                yield batch(*settle(key, cls, b.column("id").to_numpy()[row], lo, run, same_document, shift))

    def group_rows(size: int):
        """Rows of the groups of ``size`` windows, cut at multiples of ``size`` before the anchor."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", _SLICE):
                wide = span_array(b.column("refine"))
                row = np.repeat(np.arange(len(wide)), [len(x) for x in wide])
                if not len(row):
                    continue
                lo, n, reach = np.concatenate(wide).T
                # Groups are numbered by (anchor - start) // size; a run of starts has a first and a last group.
                high, low = reach // size, (reach - n + 1) // size
                count = high - low + 1
                upto = np.concatenate(([0], np.cumsum(count)))
                group = np.repeat(high + upto[:-1], count) - np.arange(upto[-1])
                row, anchor, first, last = (np.repeat(x, count) for x in (row, lo + reach, lo, lo + n - 1))
                first, last = np.maximum(first, anchor - group * size - size + 1), np.minimum(last, anchor - group * size)
                of = spans(b.column("text"))
                key = of(row, anchor - group * size, anchor - group * size - size + 1 + window, 0)
                cls = of(row, first, last + window, 1)
                shape = run_of(last - first + 1, anchor - first)
                yield batch(mix(key ^ mix(group.astype(U64) * U64(size > 1))), mix(cls ^ mix(shape.astype(U64) * U64(size > 1))), b.column("id").to_numpy()[row], first, shape)

        return rows

    def by_document(found: DataFrame, name: str) -> DataFrame:
        pick = [F.collect_set(F.when(c, F.struct("lo", "run"))).alias(k) for k, c in ((name, ~F.col("refine")), ("refine", F.col("refine")))]
        return stored(found.groupBy("id").agg(*pick), name)

    coarse = by_document(later(docs.mapInArrow(anchor_rows, schema), same_document, shift), "coarse")
    touched = stored_by(docs.join(coarse, "id"), "touched", "id")
    edges = touched.where(F.size("refine") > 0).select("id", "text", "refine")
    middle = by_document(later(edges.mapInArrow(group_rows(min(GROUP, max(1, window // 2))), schema), same_document, shift), "middle")
    edges = touched.select("id", "text").join(middle.where(F.size("refine") > 0).select("id", "refine"), "id")
    fine = by_document(later(edges.mapInArrow(group_rows(1), schema), same_document, shift), "fine")
    none = F.array().cast("array<struct<lo:int,run:int>>")
    decided = coarse.select("id", "coarse").join(middle.select("id", "middle"), "id", "left").join(fine.select("id", "fine"), "id", "left")
    decided = decided.select("id", F.concat("coarse", F.coalesce("middle", none), F.coalesce("fine", none)).alias("spans")).where(F.size("spans") > 0)
    return touched.select("id", "text").join(decided, "id")


def covered(size: int, spans: np.ndarray, window: int) -> np.ndarray:
    """Which of ``size`` units the windows starting in ``spans`` (rows lo, n, reach) cover."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 0] + spans[:, 1] + window - 1, -1)
    return np.cumsum(step[:-1]) > 0


def span_array(column: pa.Array) -> list[np.ndarray]:
    """Rows (lo, n, reach) of each list of a list<struct<lo, run>> column."""
    flat = column.flatten()
    lo, run = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "run"))
    rows = np.stack([lo, run & 0xFFFF, run >> 16], axis=1)
    return np.split(rows, np.cumsum(column.value_lengths().to_numpy())[:-1])
