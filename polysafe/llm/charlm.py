"""Interpolated modified Kneser-Ney model of the bytes of texts, in Spark tables that grow with what it is trained on.

An n-gram is the number of its bytes, so names are exact; zeros stand before a
text.  By order, the model holds each n-gram's discounted share of its context
and each context's weight for the order below.  An n-gram lies in the shard of
its context, so what a context holds (256 n-grams at most) is weighed in one
window and a shard can answer for n-grams that it has never seen.

Texts are cut into slices.  A slice asks the shards once for each of its
different n-grams, whatever number of its texts hold them, and the answers meet
the slice again, where the orders are interpolated and summed by text.  So a
common n-gram costs a row per slice, and no text is sent to a shard.

Texts are halved by a minimum hash of their word 3-grams, so that copies and
most near copies stay together: a text is judged by the model of the other half.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polysafe.llm.common import SLICE_BYTES, U64, discard, mix, shuffle_parts, slices, span_hash, stored, text_buffer, word_spans

#: Bytes of the longest n-grams: what a 64-bit number holds beside a text's place in its slice.
ORDER = 6
#: Documents are scored in so many parts: a part's slices and answers are removed before the next, so disk stays a fixed share of the input.
WAVES = 4
#: n-grams a counting task holds before it hands them on.
HELD = 4 << 20

_PLACE = U64(16)
_BYTE = U64(8)


def _mask(k: int) -> np.uint64:
    return U64((1 << (8 * k)) - 1)


def _tag(k: int, half: int) -> np.uint64:
    """Stands above the bytes of an n-gram of order ``k`` of a half's model."""
    return U64((2 * k + half) << (8 * ORDER))


def halves(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The half (0 or 1) of each text, by the least hash of its word 3-grams; two starts stand before a text, an end after it."""
    start, end, doc = word_spans(buf, offs)
    n = np.bincount(doc, minlength=len(offs) - 1)
    size = n + 3
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    raw = np.ones(len(place), U64)
    raw[ends - 1] = 2
    raw[(place >= 2) & (place < np.repeat(size, size) - 1)] = span_hash(buf, start, end)
    full = np.flatnonzero(place >= 2)
    three = mix(raw[full - 2] ^ mix(raw[full - 1] ^ mix(raw[full] + U64(7))))
    return (mix(np.minimum.reduceat(three, np.cumsum(n + 1) - n - 1)) & U64(1)).astype(np.int64)


def codes(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """n-gram of full order that ends at each byte; zeros stand before each text."""
    code = buf.astype(U64)
    for back in range(1, ORDER):
        code[back:] |= buf[:-back].astype(U64) << U64(8 * back) if len(buf) > back else U64(0)
    for back in range(ORDER - 1):
        at = offs[:-1] + back
        at = at[at < offs[1:]]
        code[at] &= _mask(back + 1)
    return code


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; a fixed 0.5, 1, 1.5 where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    out = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), k) for k, d in zip((1, 2, 3), out))


def _counted(codes_: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes_, kind="stable")
    codes_, n = codes_[order], n[order]
    first = np.flatnonzero(np.append(True, codes_[1:] != codes_[:-1]))
    return codes_[first], np.add.reduceat(n, first)


def count(texts: DataFrame) -> DataFrame:
    """``code, c``: n-grams of full order of all texts (column ``text``), tagged by half, and how often each occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            code, n = _counted(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n)], names=["code", "c"])

        for b in slices(batches, "text"):
            buf, offs = text_buffer(b.column("text"))
            if not len(buf):
                continue
            half = np.repeat(halves(buf, offs), np.diff(offs))
            code = np.sort(codes(buf, offs) | (half.astype(U64) << U64(8 * ORDER)))
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            held.append((code[first], np.diff(np.append(first, len(code)))))
            size += len(first)
            if size > HELD:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(rows, "code long, c long").groupBy("code").agg(F.sum("c").alias("c"))


def shard_of(key: np.ndarray, parts: int) -> np.ndarray:
    """Shard of each tagged n-gram: that of its order, half and context."""
    low = _mask(ORDER)
    context = ((key & low) >> _BYTE) | (key & ~low)
    return ((mix(context) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def train(trusted: DataFrame) -> DataFrame:
    """``shard, key, share, weight`` (packed): the models of both halves of ``trusted`` (column ``text``); no rows without any text."""
    spark = trusted.sparkSession
    parts = shuffle_parts(spark)
    level, model = stored(count(trusted), "grams"), None
    half = 1 << (8 * ORDER)
    for k in range(ORDER, 0, -1):
        m = F.shiftright("code", 8 * ORDER)
        ones = [F.count(F.when(F.col("c") == j, 1)).alias(f"n{j}") for j in (1, 2, 3, 4)]
        got = {r.m: discounts(*r[1:]) for r in level.groupBy(m.alias("m")).agg(*ones).collect()}  # two rows
        cut = [F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]) for d in (got.get(h, (0.5, 1.0, 1.5)) for h in (0, 1))]
        rows = _weighed(level.withColumn("d", F.when(m == 0, cut[0]).otherwise(cut[1])), k, parts)
        # One order after the other; the shuffles of the long n-grams, the greater ones, are let go in between.
        table = stored(rows, "model", k > 4)
        model = table if model is None else model.unionByName(table)
        if k > 1:
            # Below the highest order an n-gram counts as often as it continues different bytes.
            shorter = F.col("code").bitwiseAND(half | ((1 << (8 * (k - 1))) - 1))
            lower = stored(level.groupBy(shorter.alias("code")).agg(F.count(F.lit(1)).alias("c")), "grams", k > 5)
            discard(level)
            level = lower
    discard(level)
    return model


def _weighed(level: DataFrame, k: int, parts: int) -> DataFrame:
    """The model's rows of order ``k`` from ``code, c, d``."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column("code").to_numpy().astype(U64)
            key = code + U64((2 * k) << (8 * ORDER))
            context = code >> _BYTE  # the half's bit moves into the bytes' place, above those of the context
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard_of(key, parts)), pa.array(context.astype(np.int64)), pa.array(key.astype(np.int64)), b.column("c"), b.column("d")], names=["shard", "ctx", "key", "c", "d"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            shard, key, share, weight = (b.column(c).to_numpy() for c in ("shard", "key", "share", "weight"))
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            spans = [slice(x, y) for x, y in zip(edges, np.append(edges[1:], len(shard)))]
            blocks = [[x[s].tobytes() for s in spans] for x in (key, share.astype("<f4"), weight.astype("<f4"))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[edges]), *(pa.array(x, pa.binary()) for x in blocks)], names=["shard", "key", "share", "weight"])

    whole = Window.partitionBy("shard", "ctx")
    rows = level.mapInArrow(placed, "shard int, ctx long, key long, c long, d double").repartition(parts, "shard")
    total = F.sum("c").over(whole)
    rows = rows.select("shard", "key", ((F.col("c") - F.col("d")) / total).alias("share"), (F.sum("d").over(whole) / total).alias("weight"))
    return rows.mapInArrow(packed, "shard int, key binary, share binary, weight binary")


class Grams:
    """The different n-grams of a slice's texts, and which text holds which how often."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, half: int, parts: int):
        doc = np.repeat(np.arange(len(offs) - 1, dtype=U64), np.diff(offs))
        both = np.sort(codes(buf, offs) << _PLACE | doc)
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        self.n = np.diff(np.append(first, len(both)))
        self.doc = (both[first] & U64((1 << 16) - 1)).astype(np.int64)
        code = both[first] >> _PLACE
        new = np.append(True, code[1:] != code[:-1]) if len(code) else np.zeros(0, bool)
        self.gram = np.cumsum(new) - 1
        code = code[new]
        #: By order, its tagged n-grams and the place there of each n-gram of full order.
        self.orders = []
        for k in range(1, ORDER + 1):
            shorter, place = np.unique(code & _mask(k), return_inverse=True)
            self.orders.append((shorter | _tag(k, half), place))
        key = np.concatenate([x for x, _ in self.orders])
        #: All of them by shard: the order of sending, and where each shard's begin.
        shard = shard_of(key, parts)
        self.sent = np.argsort(shard, kind="stable")
        self.keys = key[self.sent]
        self.shards, self.begin = np.unique(shard[self.sent], return_index=True)

    def sums(self, share: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
        """Log probability of each text from what the shards answered, in the order of sending."""
        own = np.empty((2, len(self.keys)))
        own[:, self.sent] = share, weight
        at, p = 0, np.full(len(self.orders[0][1]), 1 / 256)
        for key, place in self.orders:
            p = own[0, at:at + len(key)][place] + own[1, at:at + len(key)][place] * p
            at += len(key)
        return np.bincount(self.doc, np.log(np.maximum(p, 1e-30))[self.gram] * self.n, texts)


def _packed(x: np.ndarray) -> bytes:
    """Numbers of one kind, compressed byte by byte: neighbours are alike in most of their bytes."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(block: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(block, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).reshape(n)


#: Rows of a shard: its part of the model (kind 0) and questions (1); rows of a slice: answers (1) and the texts (2).
MEETING = "shard int, kind int, slice string, a binary, b binary, c binary"


def _rows(shards, kind: int, name: str | None, *columns: list) -> pa.RecordBatch:
    n = len(shards)
    return pa.RecordBatch.from_arrays(
        [pa.array(shards, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([name] * n, pa.string()), *(pa.array(x, pa.binary()) for x in columns)],
        names=["shard", "kind", "slice", "a", "b", "c"])


def _texts(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _cut(docs: DataFrame) -> DataFrame:
    """The texts in slices of one half each (``MEETING``, kind 2; the half as ``shard``)."""

    def sealed(half: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        for k in range(0, whole.num_rows, 1 << 16):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(whole.slice(k, 1 << 16))
            yield _rows([half], 2, uuid.uuid4().hex, [sink.getvalue().to_pybytes()], [None], [None])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], []), [0, 0]
        for b in slices(batches, "text", SLICE_BYTES // 2):
            buf, offs = text_buffer(b.column("text"))
            half, n = halves(buf, offs), np.diff(offs)
            for h in (0, 1):
                at = np.flatnonzero(half == h)
                if not len(at):
                    continue
                more = int(n[at].sum())
                if held[h] and size[h] + more > SLICE_BYTES:
                    yield from sealed(h, held[h])
                    held[h].clear()
                    size[h] = 0
                held[h].append(b.take(pa.array(at)))
                size[h] += more
        for h in (0, 1):
            if held[h]:
                yield from sealed(h, held[h])

    return docs.select("id", "lang", "text").mapInArrow(rows, MEETING)


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """``id, lang, perplexity`` of every row of ``docs`` (``id, lang, text``), by byte; null for empty texts."""
    parts = shuffle_parts(docs.sparkSession)
    held = model.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("slice"), F.col("key").alias("a"), F.col("share").alias("b"), F.col("weight").alias("c"))
    out = None
    for k in range(WAVES):
        cut = stored(_cut(docs.where(F.pmod(F.xxhash64("id", "text"), F.lit(WAVES)) == k)), "slices", False)
        scored = stored(_answered(cut, held, parts), "scored")
        discard(cut)
        out = scored if out is None else out.unionByName(scored)
    return out


def _answered(cut: DataFrame, held: DataFrame, parts: int) -> DataFrame:

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for half, name, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "slice", "a"))):
                g = Grams(*text_buffer(_texts(blob).column("text")), 1 - half, parts)
                edges = np.append(g.begin, len(g.keys))
                for k in range(0, len(g.shards), 64):
                    spans = list(zip(edges[k:k + 64], edges[k + 1:k + 65]))
                    blocks = [_packed(np.diff(g.keys[x:y], prepend=U64(0))) for x, y in spans]  # keys of a shard rise
                    yield _rows(g.shards[k:k + 64], 1, name, blocks, [int(y - x).to_bytes(8, "little") for x, y in spans], [None] * len(spans))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, index, at = [], None, None
        for b in batches:
            for shard, kind, name, x, y, z in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "slice", "a", "b", "c"))):
                if shard != at:
                    blocks, index, at = [], None, shard
                if kind == 0:
                    blocks.append((np.frombuffer(x, "<u8"), np.frombuffer(y, "<f4"), np.frombuffer(z, "<f4")))
                    continue
                if index is None:
                    index = Index(blocks)
                yield _rows([shard], 1, name, [None], *([_packed(v)] for v in index.find(np.cumsum(_unpacked(x, int.from_bytes(y, "little"), "<u8"), dtype=U64))))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a slice stand together, its texts last."""
        answers, at = {}, None
        for b in batches:
            for shard, kind, name, x, y, z in zip(*(b.column(c).to_pylist() for c in ("shard", "kind", "slice", "a", "b", "c"))):
                if name != at:
                    answers, at = {}, name
                if kind == 1:
                    answers[shard] = y, z
                    continue
                texts = _texts(x)
                buf, offs = text_buffer(texts.column("text"))
                size = np.diff(offs)
                logs = np.zeros(len(size))
                if len(buf):
                    g = Grams(buf, offs, 1 - shard, parts)
                    n = np.diff(np.append(g.begin, len(g.keys))).tolist()
                    share, weight = (np.concatenate([_unpacked(answers[s][j], c, "<f4") for s, c in zip(g.shards.tolist(), n)]) for j in (0, 1))
                    logs = g.sums(share, weight, len(size))
                out = np.exp(-logs / np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays([texts.column("id"), texts.column("lang"), pa.array(out, mask=size == 0)], names=["id", "lang", "perplexity"])

    met = cut.mapInArrow(ask, MEETING).unionByName(held).repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(answer, MEETING)
    return met.unionByName(cut).repartition(parts, "slice").sortWithinPartitions("slice", "kind").mapInArrow(total, "id long, lang string, perplexity double")


class Index:
    """A shard of the model, to look up n-grams in."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]]):
        key, share, weight = (np.concatenate(c) for c in zip(*blocks)) if blocks else (np.zeros(0, d) for d in ("<u8", "<f4", "<f4"))
        order = np.argsort(key, kind="stable")
        self.key, self.share, self.weight = key[order], share[order], weight[order]

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share, weight of the context) of each n-gram; 0 if it is not known, 1 if its context is not."""
        share, weight = np.zeros(len(asked), "<f4"), np.ones(len(asked), "<f4")
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, asked), len(self.key) - 1)
            known = self.key[at] == asked
            share[known], weight[known] = self.share[at[known]], self.weight[at[known]]
            # The n-grams of a context stand together: the next one, or the one before, shows whether it is known.
            for near in (at, np.maximum(at - 1, 0)):
                same = self.key[near] >> _BYTE == asked >> _BYTE
                weight[same] = self.weight[near[same]]
        return share, weight
