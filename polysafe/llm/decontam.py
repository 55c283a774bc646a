"""Benchmark passages inside documents, by the q-gram lemma and banded alignment.

An item of m characters that occurs with at most e edits shares at least
m - q + 1 - q e q-grams with the place, on diagonals at most e apart.  Shared
q-grams are counted in diagonal bands of 2 (e + 1), each overlapping the next
by half; only bands that reach the bound are aligned.  Where asked for, items
too short for their edits at the usual q take the longest q that their edits
allow, and those below the usual q are looked up whole.

Both sides are compared lower-cased, every run of characters other than
letters and digits being one blank.  Characters are UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from polysafe.llm.common import U64, prepare, slices, text_buffer, windows_hash

Q = 12
#: Edits allowed per character of an item.
EDIT_RATE = 0.05
#: Benchmark text broadcast at once; a larger benchmark is taken in blocks of this size.
BLOCK_BYTES = 8 << 20

_KEEP = np.zeros(256, bool)
_KEEP[ord("0"):ord("9") + 1] = True
_KEEP[ord("a"):ord("z") + 1] = True
_KEEP[128:] = True
_FILTER_BITS = 22


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the compared form of each text; a blank also ends each text."""
    buf, offs = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offs) - 1
    wide = np.full(len(buf) + n, 32, np.uint8)
    at = np.arange(len(buf)) + np.repeat(np.arange(n), np.diff(offs))
    wide[at] = np.where(_KEEP[buf], buf, np.uint8(32))
    ends = offs[1:] + np.arange(1, n + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    if n:
        first = np.concatenate(([0], ends[:-1]))
        first = first[first < len(wide)]
        keep[first] = wide[first] != 32
    upto = np.concatenate(([0], np.cumsum(keep)))
    return wide[keep], np.concatenate(([0], upto[ends])) if n else np.zeros(1, np.int64)


class Index(NamedTuple):
    """Q-grams of a block of items: where each occurs."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that an occurrence must reach
    grams: np.ndarray  # sorted, distinct
    at: np.ndarray  # postings of each gram
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray  # bit filter over gram hashes


def build(ids: list, texts: pa.Array, q: int, rate: float) -> Index:
    buf, offs = normalised(texts)
    size = np.maximum(np.diff(offs) - 1, 0)  # without the ending blank
    edits = np.maximum(np.minimum((size * rate).astype(np.int64), (size - q) // q), 0)
    grams, item, place, bodies = [], [], [], []
    for k, n in enumerate(size):
        body = buf[offs[k]:offs[k] + n]
        bodies.append(body.tobytes())
        g = windows_hash(body.astype(U64), q)
        grams.append(g)
        item.append(np.full(len(g), k))
        place.append(np.arange(len(g)))
    gram, item, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, item, place))
    gram = gram.astype(U64)
    order = np.argsort(gram, kind="stable")
    distinct, first = np.unique(gram[order], return_index=True)
    seen = np.zeros(1 << _FILTER_BITS, bool)
    seen[(distinct >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
    return Index(ids, bodies, edits, size - q + 1 - q * edits, distinct, np.append(first, len(gram)), item[order], place[order], seen)


def align(item: bytes, text: bytes, lo: int, hi: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of ``item`` in ``text`` on the diagonals lo..hi, as (edits, start, end); None beyond ``most``."""
    at = text.find(item, max(0, lo), max(0, hi) + len(item))
    if at >= 0:
        return 0, at, at + len(item)
    a, t = np.frombuffer(item, np.uint8), np.frombuffer(text, np.uint8)
    diag = np.arange(lo, hi + 1)
    step = np.arange(len(diag))
    far = len(item) + len(text) + 1
    cost = np.where((diag >= 0) & (diag <= len(t)), 0, far)
    start = diag.copy()
    for i in range(len(a)):
        j = diag + i  # text place compared with item place i
        inside = (j >= 0) & (j < len(t))
        same = np.zeros(len(diag), bool)
        same[inside] = t[j[inside]] == a[i]
        best = np.where(inside, cost + ~same, far)
        origin = start.copy()
        gone = np.append(cost[1:], far) + 1  # an item character without a partner
        use = gone < best
        best, origin = np.where(use, gone, best), np.where(use, np.append(start[1:], 0), origin)
        run = np.minimum.accumulate(best - step)  # text characters without a partner
        source = np.maximum.accumulate(np.where(best - step == run, step, 0))
        cost, start = run + step, origin[source]
        if cost.min() > most:
            return None
    k = int(np.argmin(cost))
    return (int(cost[k]), int(start[k]), int(diag[k]) + len(a)) if cost[k] <= most else None


def shared_grams(buf: np.ndarray, offs: np.ndarray, index: Index, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in ``buf``, item, place in the item) of every q-gram that a text shares with an item."""
    grams = windows_hash(buf.astype(U64), q)
    if not len(grams) or not len(index.grams):
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(index.seen[(grams >> U64(64 - _FILTER_BITS)).astype(np.int64)])
    row = np.searchsorted(offs, at, side="right") - 1
    at = at[at + q < offs[row + 1]]
    k = np.searchsorted(index.grams, grams[at])
    hit = index.grams[np.minimum(k, len(index.grams) - 1)] == grams[at]
    at, k = at[hit], k[hit]
    many = index.at[k + 1] - index.at[k]
    upto = np.concatenate(([0], np.cumsum(many)))
    post = np.repeat(index.at[k] - upto[:-1], many) + np.arange(upto[-1])
    return np.repeat(at, many), index.item[post], index.place[post]


def search_short(texts: pa.Array, index: Index, size: int, whole: bool) -> list[tuple[int, int, int, int, int]]:
    """Like ``search`` for items of ``size`` characters that stand alone: as the ``whole`` text, or as words of it."""
    buf, offs = normalised(texts)
    at, item, _ = shared_grams(buf, offs, index, size)
    if not len(at):
        return []
    row = np.searchsorted(offs, at, side="right") - 1
    bodies = np.array([np.frombuffer(x, np.uint8) for x in index.texts])
    alone = (buf[at[:, None] + np.arange(size)] == bodies[item]).all(axis=1)
    first, last = at == offs[row], at + size == offs[row + 1] - 1
    if not whole:  # letters of scripts written without blanks stand beside others
        first |= (buf[at - 1] == 32) | (buf[at] >= 128)
        last |= (buf[at + size] == 32) | (buf[at + size - 1] >= 128)
    alone &= first & last
    at, item, row = at[alone], item[alone], row[alone]
    return [(r, i, 0, s, s + size) for r, i, s in sorted(zip(row.tolist(), item.tolist(), (at - offs[row]).tolist()))]


def search(texts: pa.Array, index: Index, q: int) -> list[tuple[int, int, int, int, int]]:
    """(row, item, edits, start, end) of each occurrence; overlapping finds of an item are the one of fewest edits."""
    buf, offs = normalised(texts)
    at, item, place = shared_grams(buf, offs, index, q)
    if not len(at):
        return []
    row = np.searchsorted(offs, at, side="right") - 1
    able = index.least[item] >= 1
    at, item, place, row = at[able], item[able], place[able], row[able]
    diag = at - offs[row] - place
    width = index.edits[item] + 1
    band = diag // width
    low = int(band.min(initial=0)) - 1
    span = int(band.max(initial=0)) - low + 1
    pair = row * len(index.ids) + item
    key, count = np.unique(np.concatenate([pair * span + (band - low), pair * span + (band - 1 - low)]), return_counts=True)
    pair, band = key // span, key % span + low
    full = count >= index.least[pair % len(index.ids)]
    found: dict[tuple[int, int], list] = {}
    for p, b in zip(pair[full].tolist(), band[full].tolist()):
        r, i = divmod(p, len(index.ids))
        e = int(index.edits[i])
        text = buf[offs[r]:offs[r + 1] - 1].tobytes()
        got = align(index.texts[i], text, b * (e + 1) - e, (b + 2) * (e + 1) + e, e)
        if got:
            own = found.setdefault((r, i), [])
            for k, old in enumerate(own):
                if got[1] < old[2] and old[1] < got[2]:
                    own[k] = min(old, got)
                    break
            else:
                own.append(got)
    return [(r, i, *x) for (r, i), own in sorted(found.items()) for x in sorted(own, key=lambda x: x[1])]


def by_length(table: pa.Table, q: int, rate: float) -> list[tuple[int, bool, Index]]:
    """(q-gram length, whether items are that long, index) of the items that share a length: ``q`` for all but short ones."""
    texts = table["text"].combine_chunks()
    size = np.maximum(np.diff(normalised(texts)[1]) - 1, 0)
    length = np.minimum(q, size // ((size * rate).astype(np.int64) + 1))
    alone = size < q
    length[alone] = size[alone]
    out = []
    for n, short in sorted({(int(n), bool(a)) for n, a in zip(length, alone) if n}):
        at = pa.array(np.flatnonzero((length == n) & (alone == short)))
        out.append((n, short, build(table["item"].take(at).to_pylist(), texts.take(at), n, rate)))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[pa.Table]:
    """The stated queries in blocks of bounded size, one in the driver at a time."""
    items = benchmark.select(F.col(id_col).alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("_part").orderBy("item", "text").rowsBetween(Window.unboundedPreceding, 0))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Enough hash parts that one fits, most likely; within a part, a running sum cuts what is still too large.
    parts = max(1, 2 * total // block_bytes)
    placed = items.withColumn("_part", F.pmod(F.xxhash64("text"), F.lit(parts))).withColumn("_block", F.floor(upto / block_bytes))
    for p in placed.select("_part", "_block").distinct().orderBy("_part", "_block").toLocalIterator() if parts > 1 else [(0, None)]:
        block = placed if p[1] is None else placed.where((F.col("_part") == p[0]) & (F.col("_block") == p[1]))
        yield block.select("item", "text").orderBy("item", "text").toArrow()


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES,
    short: str | None = None,
) -> DataFrame:
    """``<id>, <item>, edits, start, end``: every occurrence of a benchmark item in a document.

    ``start`` and ``end`` are places in the compared form of the text.  An item
    of m characters may differ by floor(m * edit_rate) edits, or as many as
    the lemma allows.  ``short`` names what is done with items for which ``q``
    is too long: None keeps to ``q``, so those of fewer than ``q`` characters are
    not searched and some others have fewer edits than the rate gives.
    ``"words"`` gives each item all its edits, and finds items of
    fewer than ``q`` characters unchanged where they are words of their own (an
    end that is not an ASCII letter or digit may touch others);
    ``"whole"`` finds these only in documents that hold nothing else.  Items
    without letters and digits are never found.  Null texts hold nothing; repeated rows
    are searched each; an empty table on either side gives no rows; other
    columns are ignored; texts are read whole.
    """
    spark = docs.sparkSession
    prepare(spark)
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, start int, end int"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")

    def occurrences(table: pa.Table) -> DataFrame:
        kind = table.schema.field("item").type
        parts = [(q, False, build(table["item"].to_pylist(), table["text"].combine_chunks(), q, edit_rate))] if short is None else by_length(table, q, edit_rate)
        shared = spark.sparkContext.broadcast(parts)  # at most block_bytes of items

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                for length, alone, index in shared.value:
                    got = search_short(b.column("text"), index, length, short == "whole") if alone else search(b.column("text"), index, length)
                    if got:
                        row, item, edits, start, end = zip(*got)
                        yield pa.RecordBatch.from_arrays(
                            [b.column("id").take(pa.array(row)), pa.array([index.ids[i] for i in item], kind), *(pa.array(x, pa.int32()) for x in (edits, start, end))],
                            names=["id", "item", "edits", "start", "end"])

        return source.mapInArrow(rows, schema)

    out = None
    for table in blocks_of(benchmark, item_col, item_text_col, block_bytes):
        if table.num_rows:
            out = occurrences(table) if out is None else out.unionByName(occurrences(table))
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **search_by) -> DataFrame:
    """The rows of ``docs`` whose id has no occurrence of a benchmark item, all columns as they were.

    Items too short for a q-gram remove a document only where they are its whole text.
    """
    hit = find_passages(docs, benchmark, id_col, text_col, **{"short": "whole", **search_by}).select(F.col(id_col).alias("_hit_id")).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("_hit_id")), "left_anti")
