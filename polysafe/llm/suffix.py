"""Repeated byte strings by window anchors and content fingerprints.

This stands in for bucket-pointer refinement: the least q-gram hash of every
window is its anchor, and runs of windows with one anchor are compared by
fingerprints of their content at three fixed levels, the run, groups of
windows, and single windows.  No suffixes are sorted; groups that are alike
or alone go no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, mix, slices, text_buffer
from polysafe.llm.repeats import BYTE_VALUES, NULL_ID, Prefix, covered, repeated, run_of, span_array
from polysafe.llm.rows import each_row

WINDOW = 100
Q = 32


def bucket_anchors(texts: pa.Array, window: int = WINDOW, q: int = Q):
    buf, offs = text_buffer(texts)
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none, none, none, none.astype(U64), none.astype(U64)
    one, two = Prefix(BYTE_VALUES[0][buf], 0), Prefix(BYTE_VALUES[1][buf], 1)
    bucket = mix(one.every(q))
    bits = U64(len(bucket).bit_length())
    least = (bucket >> bits << bits) | np.arange(len(bucket), dtype=U64)
    width, span = window - q + 1, 1
    while span * 2 <= width:  # least of spans twice as wide, then of the wanted width from two that overlap
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    starts = np.arange(len(least))
    row = np.searchsorted(offs, starts, side="right") - 1
    inside = starts + window <= offs[row + 1]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return none, none, none, none.astype(U64), none.astype(U64)
    place = (least[starts] & U64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    lo = starts[new]
    n = np.diff(np.append(np.flatnonzero(new), len(starts)))
    place, row = place[new], row[new]
    run = run_of(n, place - lo)
    cls = mix(two.span(lo, lo + n - 1 + window) ^ mix(run.astype(U64)))
    return row, lo - offs[row], run, bucket[place], cls


def byte_spans(texts: pa.Array):
    buf, offs = text_buffer(texts)
    lanes = [Prefix(BYTE_VALUES[k][buf], k) for k in (0, 1)]
    return lambda row, start, end, lane: lanes[lane].span(offs[row] + start, offs[row] + end)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, q: int = Q) -> DataFrame:
    """``<id>, n_bytes, n_removed, n_spans, kept_sha256, removed`` for every row.

    A byte goes if a string of ``window`` bytes over it also starts earlier: in
    a document of smaller id, or before in the same one.  ``removed`` lists
    the maximal removed runs (start, length) in bytes.  Null text is empty; a
    null id comes before all others; rows that share an id are documents of
    their own, in the order of their texts' digests, and rows equal in id and
    text are one, its result given for each; an empty table gives no rows;
    other columns are ignored; texts are read whole.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = each_row(source, lambda rows, _: _cut(rows, window, q))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed")


def _cut(source: DataFrame, window: int, q: int) -> DataFrame:
    found = repeated(source, lambda t: bucket_anchors(t, window, q), byte_spans, window, same_document=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            done = []
            for k, spans in enumerate(span_array(b.column("spans"))):
                text = buf[offs[k]:offs[k + 1]]
                gone = covered(len(text), spans, window)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
                runs = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                done.append((int(gone.sum()), len(runs), hashlib.sha256(text[~gone].tobytes()).hexdigest(), runs))
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]),
                 pa.array(cols[3], pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))],
                names=["id", "n_removed", "n_spans", "kept_sha256", "removed"])

    cut = found.mapInArrow(rows, "id long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,length:int>>")
    plain = source.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("_whole"))
    return plain.join(cut, "id", "left").select(
        "id", "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), "removed")
