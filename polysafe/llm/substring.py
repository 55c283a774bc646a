"""Repeated word windows by recompression.

A round splits the alphabet of symbols into a left and a right half and
replaces every pair (left, right) by one symbol named after both, so a word
sequence gets the same interior symbols wherever it occurs: a symbol of
round r spans at most 2^r words and depends on at most 2^r - 1 words to either
side.  Names are fingerprints of what they stand for, the same in all tasks.
Runs of one word stay as they are: equal neighbours are in the same half.

Rounds go on as long as every window is sure to hold a whole symbol with
the words it depends on.  A window's anchor is the least such symbol; shared
symbols reveal repeats, fingerprints of the words around verify them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, mix, slices, span_hash, text_buffer, word_spans
from polysafe.llm.repeats import NULL_ID, Prefix, covered, repeated, run_of, span_array
from polysafe.llm.rows import each_row

WINDOW = 13


def rounds_for(window: int) -> int:
    """Rounds r with 2 * (2^r - 1) words of context and 2 * 2^r - 1 words that hold a whole symbol."""
    return max(0, ((window + 3) // 4).bit_length() - 1)


def compress(name: np.ndarray, row: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the symbols after some rounds; symbols never cross rows."""
    start = np.arange(len(name))
    for r in range(rounds):
        right = mix(name ^ mix(np.full(1, r + 1, U64))) >> U64(63) == 1
        pair = np.flatnonzero(~right[:-1] & right[1:] & (row[start[:-1]] == row[start[1:]]))
        name = name.copy()
        name[pair] = mix(name[pair] * U64(0x9E3779B97F4A7C15) + mix(name[pair + 1]) + U64(r))
        keep = np.ones(len(name), bool)
        keep[pair + 1] = False
        name, start = name[keep], start[keep]
    return name, start


def symbol_anchors(texts: pa.Array, window: int = WINDOW):
    buf, offs = text_buffer(texts)
    begin, end, row = word_spans(buf, offs)
    none = np.zeros(0, np.int64)
    starts = np.arange(max(0, len(row) - window + 1))
    starts = starts[row[starts] == row[starts + window - 1]] if len(starts) else starts
    if not len(starts):
        return none, none, none, none.astype(U64), none.astype(U64)
    word = span_hash(buf, begin, end)
    rounds = rounds_for(window)
    margin = (1 << rounds) - 1
    name, first = compress(word, row, rounds)
    past = np.append(first[1:], len(word))
    # The whole symbols of a window, context included, and the least of them.
    a = np.searchsorted(first, starts + margin, side="left")
    z = np.searchsorted(past, starts + window - margin, side="right")
    bits = U64(len(name).bit_length())
    level = [(mix(name) >> bits << bits) | np.arange(len(name), dtype=U64)]
    while 1 << len(level) <= int((z - a).max()):
        half = 1 << (len(level) - 1)
        level.append(np.minimum(level[-1], np.append(level[-1][half:], np.full(half, U64(2**64 - 1)))))
    depth = np.frexp(z - a)[1] - 1
    table = np.stack(level)
    least = np.minimum(table[depth, a], table[depth, z - (1 << depth)])
    symbol = (least & U64((1 << int(bits)) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (symbol[1:] != symbol[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    lo, symbol = starts[new], symbol[new]
    n = np.diff(np.append(np.flatnonzero(new), len(starts)))
    one, two = Prefix(word, 0), Prefix(span_hash(buf, begin, end, lane=1), 1)
    at = first[symbol]
    key = mix(one.span(at - margin, past[symbol] + margin) + mix(name[symbol]))
    run = run_of(n, at - lo)
    cls = mix(two.span(lo, lo + n - 1 + window) ^ mix(run.astype(U64)))
    base = np.searchsorted(row, row[lo], side="left")
    return row[lo], lo - base, run, key, cls


def word_window_spans(texts: pa.Array):
    buf, offs = text_buffer(texts)
    begin, end, of = word_spans(buf, offs)
    lanes = [Prefix(span_hash(buf, begin, end, lane=k), k) for k in (0, 1)]
    first = np.searchsorted(of, np.arange(len(texts)), side="left")
    return lambda row, start, stop, lane: lanes[lane].span(first[row] + start, first[row] + stop)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``<id>, n_words, n_removed, kept_sha256, kept`` for every row.

    A word goes if a window of ``window`` words over it also starts in a document
    of smaller id.  ``kept`` is the remaining text, words joined by one space,
    where words were removed (else null: the text stays as it is).  Null text
    has no words; a null id comes before all others; rows that share an id are
    documents of their own, none before another; an empty table gives no rows;
    other columns are ignored; texts are read whole.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = each_row(source, lambda rows, shift: _cut(rows, window, shift))
    return out.select(F.when(F.col("id") != NULL_ID, F.col("id")).alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")


def _cut(source: DataFrame, window: int, shift: int) -> DataFrame:
    found = repeated(source, lambda t: symbol_anchors(t, window), word_window_spans, window, same_document=False, shift=shift)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            begin, end, row = word_spans(buf, offs)
            data = buf.tobytes()
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            done = []
            for k, spans in enumerate(span_array(b.column("spans"))):
                gone = covered(int(at[k + 1] - at[k]), spans, window)
                left = at[k] + np.flatnonzero(~gone)
                kept = b" ".join(data[s:e] for s, e in zip(begin[left], end[left]))
                done.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*done))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(cols[0], pa.int64()), pa.array(cols[1]), pa.array(cols[2], pa.string())],
                                             names=["id", "n_removed", "kept_sha256", "kept"])

    cut = found.mapInArrow(rows, "id long, n_removed long, kept_sha256 string, kept string")
    one_space = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
    plain = source.select("id", one_space.alias("_t")).select(
        "id", F.when(F.col("_t") == "", 0).otherwise(F.length("_t") - F.length(F.replace("_t", F.lit(" "))) + 1).cast("long").alias("n_words"),
        F.sha2("_t", 256).alias("_whole"))
    return plain.join(cut, "id", "left").select(
        "id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"), "kept")
