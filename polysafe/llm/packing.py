"""Packing documents into token windows by lexical retrieval.

Documents are dealt by a sketch of their token pairs, so that similar ones
meet; each run of documents is a shard with a BM25 inverted index of its own,
weighted by document frequencies over the whole corpus.  A seed document's
window is filled with the best unused neighbours its shard's index returns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, mix, prepare, shuffle_parts, signed, slices, stored
from polysafe.llm.tokens import word_tokenizer

WINDOW = 4096
#: Tokens of one index shard; the rest of a partition goes to further shards.
SHARD_TOKENS = 1 << 20
#: BM25's parameters.
K1, B = 1.2, 0.75


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """``id, sketch, ids, seen``: little-endian 32-bit ids and a minimum hash over token pairs.

    Each task adds one row without ids, whose ``seen`` is (documents, tokens,
    document frequency of each token id) of its rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokenizer(tokenizer)
        seen, kind = np.zeros(2, np.int64), None
        for b in slices(batches, "text"):
            ids, offs = encoder.encode(b.column("text"), end_id)
            pair = mix(ids.astype(U64) * U64(1 << 20) + np.append(ids[1:], 0).astype(U64))
            pair[offs[1:] - 1] = U64(2**64 - 1)
            sketch = np.minimum.reduceat(pair, offs[:-1])
            seen, kind = _added(seen, ids, offs), b.schema.field("id").type
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), b.num_rows, [None, pa.py_buffer(offs * 4), pa.py_buffer(ids.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(signed(sketch)), data.cast(pa.binary()), pa.nulls(b.num_rows, pa.binary())], names=NAMES)
        if kind is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([seen.astype("<i8").tobytes()], pa.binary())], names=NAMES)

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(rows, "id long, sketch long, ids binary, seen binary")


NAMES = ["id", "sketch", "ids", "seen"]
#: Documents marked at once, a byte a token id each (so many fit a byte's sum).
_MARKED = 255


def _added(seen: np.ndarray, ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """``seen`` with some more documents."""
    top = int(ids.max()) + 1
    out = np.zeros(max(len(seen), top + 2), np.int64)
    out[:len(seen)] = seen
    for at in range(0, len(offs) - 1, _MARKED):
        edge = offs[at:at + _MARKED + 1]
        has = np.zeros((len(edge) - 1, top), np.uint8)
        has[np.repeat(np.arange(len(edge) - 1), np.diff(edge)), ids[edge[0]:edge[-1]]] = 1
        out[2:top + 2] += np.add.reduce(has, axis=0, dtype=np.uint8)
    out[:2] += len(offs) - 1, len(ids)
    return out


def _ids(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<u4") for x in column]


def term_statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """(document frequency by token id, documents, mean length), over all documents, from the rows that the tasks added.

    The vector has one entry per entry of the vocabulary, whatever the corpus.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2, np.int64)
        for b in batches:
            for x in b.column("seen"):
                more = np.frombuffer(x.as_py(), "<i8")
                total, more = (total, more) if len(total) >= len(more) else (more.copy(), total)
                total[:len(more)] += more
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at - 2), pa.array(total[at])], names=["term", "n"])

    some = tokens.where("seen IS NOT NULL").select("seen").mapInArrow(counts, "term long, n long")
    got = {r.term: r.n for r in some.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n, total = got.pop(-2, 0), got.pop(-1, 0)
    df = np.zeros(max(got, default=0) + 1, np.int64)
    df[list(got)] = list(got.values())
    return df, n, total / n if n else 0.0


class Shard:
    """BM25 inverted index of some documents; postings of a term are (document, weight)."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        v = len(idf)
        size = np.array([len(d) for d in docs])
        key, tf = np.unique(np.repeat(np.arange(len(docs)), size) * v + np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = key // v, key % v
        weight = (idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / mean)))).astype(np.float32)
        self.own = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.terms = term
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.at = np.searchsorted(term[order], np.arange(v + 1))
        self.n = len(docs)

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share any of the seed's terms, best score first, ties by place."""
        terms = self.terms[self.own[seed]:self.own[seed + 1]]
        spans = [slice(self.at[t], self.at[t + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class Windows:
    """Pieces laid into windows one after another; a document is cut where a window ends."""

    def __init__(self, first_sequence: int, window: int):
        self.sequence, self.window, self.room = first_sequence, window, window
        #: (document, start, ids, document's length, sequence, offset, sequence's length)
        self.rows: list[tuple] = []

    def put(self, doc_id, ids: np.ndarray, start: int = 0, end: int | None = None) -> None:
        """The ids from start to end, cut where windows end."""
        end = len(ids) if end is None else end
        while start < end:
            n = min(self.room, end - start)
            self.rows.append((doc_id, start, ids[start:start + n], len(ids), self.sequence, self.window - self.room, self.window))
            start, self.room = start + n, self.room - n
            if not self.room:
                self.sequence, self.room = self.sequence + 1, self.window

    def full(self) -> list[tuple]:
        """The rows of full windows, which are then forgotten."""
        done = [r for r in self.rows if r[4] != self.sequence]
        self.rows = self.rows[len(done):]
        return done

    def tail(self) -> list[tuple]:
        """The open window cut into sequences whose lengths are falling powers of two."""
        left = self.window - self.room
        out: list[tuple] = []
        size, used = 1 << left.bit_length() >> 1, 0
        for doc_id, start, ids, total, *_ in self.rows:
            at = 0
            while at < len(ids):
                n = min(size - used, len(ids) - at)
                out.append((doc_id, start + at, ids[at:at + n], total, self.sequence, used, size))
                at, used = at + n, used + n
                if used == size:
                    left -= size
                    self.sequence, size, used = self.sequence + 1, 1 << left.bit_length() >> 1, 0
        self.rows = []
        return out


def fill(shard: Shard, ids: list, docs: list[np.ndarray], out: Windows) -> None:
    """Every document of the shard into windows: a seed, then neighbours that fit, then one that is cut.

    The rest of a cut document opens the next window and is its seed.
    """
    size = np.array([len(d) for d in docs])
    unused = np.ones(len(docs), bool)
    at, seed = 0, None
    while True:
        if seed is None:
            while at < len(docs) and not unused[at]:
                at += 1
            if at == len(docs):
                return
            seed = at
            unused[seed] = False
            out.put(ids[seed], docs[seed])
        if out.room == out.window:
            seed = None
            continue
        found = shard.neighbours(seed)
        found = found[unused[found]]
        last = None
        for k in found:
            if size[k] <= out.room:
                unused[k] = False
                out.put(ids[k], docs[k])
                if out.room == out.window:
                    break
            elif last is None:
                last = k
        seed = None
        if out.room != out.window and last is not None:
            unused[last] = False
            out.put(ids[last], docs[last])
            seed = last if out.room != out.window else None


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length long")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 2, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """One row per piece of a document in a sequence, every id of every document in exactly one piece.

    All sequences are full but the last few of each partition, whose lengths
    are powers of two, so nothing is padded.  Null text is empty (its
    end id alone is packed); rows with a null or repeated id are packed each;
    an empty table gives no rows; a text of any length is cut into windows;
    other columns are ignored.  Ties in score go by (sketch, id).
    """
    spark = docs.sparkSession
    prepare(spark)
    tokens = stored(encoded(docs, id_col, text_col, tokenizer or default_tokenizer(), end_id), "tokens")
    df, n, mean = term_statistics(tokens)
    idf = spark.sparkContext.broadcast(np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32))  # one number per vocabulary entry

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Windows(TaskContext.get().partitionId() << 40, window)
        ids: list = []
        held: list[np.ndarray] = []
        total = 0

        def batch(done: list[tuple]) -> pa.RecordBatch:
            cols = zip(*((d, at, len(x), zlib.crc32(x.tobytes()), n, seq, off, size) for d, at, x, n, seq, off, size in done))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for doc_id, x in zip(b.column("id").to_pylist(), _ids(b.column("ids"))):
                ids.append(doc_id)
                held.append(x)
                total += len(x)
                if total >= shard_tokens:
                    fill(Shard(held, idf.value, mean), ids, held, out)
                    ids, held, total = [], [], 0
                    if done := out.full():
                        yield batch(done)
        if held:
            fill(Shard(held, idf.value, mean), ids, held, out)
        if done := out.full() + out.tail():
            yield batch(done)

    parts = shuffle_parts(spark)
    return tokens.where("ids IS NOT NULL").repartitionByRange(parts, "sketch", "id").sortWithinPartitions("sketch", "id").select("id", "ids").mapInArrow(rows, SCHEMA)
