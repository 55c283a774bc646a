"""Language identification by the nearest of several TF-IDF centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import U64, mix, prepare, slices, text_buffer

#: Hashed character 1- to 3-gram features.
FEATURES = 1 << 12
#: Centroids per language.
CENTROIDS = 4
#: The centroids are fitted on at most so many labelled texts per language (document frequencies cover all of them).
FIT_ROWS = 600
#: A text further from its nearest centroid than this share of the language's fitted texts is rejected.
REJECT_QUANTILE = 0.002
SEED = 17

#: Texts whose feature rows are held at once.
_ROWS = 512
_KEEP = np.zeros(256, bool)
_KEEP[ord("a"):ord("z") + 1] = True
_KEEP[128:] = True


class Model(NamedTuple):
    idf: np.ndarray
    centroids: np.ndarray  # one unit row each
    langs: list[str]  # language of each centroid
    reach: np.ndarray  # least cosine each centroid accepts


def features(texts: pa.Array) -> np.ndarray:
    """Counts of hashed n-grams, a row per text: letters lower-cased, all else one blank, n-grams of 1 to 3 UTF-8 bytes."""
    buf, offs = text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    n = len(offs) - 1
    letters = np.where(_KEEP[buf], buf, np.uint8(32))
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    keep = np.ones(len(letters), bool)  # a run of blanks is one blank
    if len(letters):
        keep[1:] = (letters[1:] != 32) | (letters[:-1] != 32) | (doc[1:] != doc[:-1])
    letters, doc = letters[keep].astype(U64), doc[keep]
    out = np.zeros(n * FEATURES, np.float32)
    code = np.zeros(len(letters), U64)
    for size in (1, 2, 3):
        if len(letters) < size:
            break
        m = len(letters) - size + 1
        code = code[:m] * U64(256) + letters[size - 1:]
        inside = doc[:m] == doc[size - 1:]
        at = doc[:m][inside] * FEATURES + (mix(code[inside] + U64(size << 32)) % U64(FEATURES)).astype(np.int64)
        out += np.bincount(at, minlength=n * FEATURES)
    return out.reshape(n, FEATURES)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def _unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, int]:
    """(texts that have each feature, texts), over all rows of ``labelled`` (column ``text``)."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for b in _blocks(batches):
            total[:FEATURES] += np.count_nonzero(features(b.column("text")), axis=0)
            total[FEATURES] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(total)], names=["feature", "n"])

    rows = labelled.select("text").mapInArrow(counts, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(FEATURES + 1, np.int64)
    for r in rows:
        total[r.feature] = r.n
    return total[:FEATURES], int(total[FEATURES])


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means of unit rows, started from rows far apart; returns unit centroids."""
    rng = np.random.default_rng(SEED)
    chosen = [int(rng.integers(len(x)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(np.max(x @ x[chosen].T, axis=1))))
    c = x[chosen]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, centroids: int = CENTROIDS, reject: float = REJECT_QUANTILE) -> Model | None:
    """Model from ``labelled`` (columns ``id, text, lang``, no null lang); None without a usable row.

    Document frequencies are over all rows.  Each language's centroids come
    from its ``fit_rows`` texts of the smallest id hash: one task of bounded
    size a language.  Texts without a letter are left out.
    """
    labelled = labelled.where(F.col("text").rlike(r"\p{L}"))
    df, n = document_frequencies(labelled)
    if not n:
        return None
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    # The id hash is uniform, so a cut at twice the wanted share leaves about 2 * fit_rows rows of a language to one task.
    ranked = labelled.select("lang", "text", F.xxhash64(F.lit(SEED), "id").alias("_h"))
    sizes = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, 2.0 * fit_rows / r.n))])
    place = (F.col("_h").cast("double") + 2.0**63) / 2.0**64
    near = ranked.where(place <= F.element_at(share, F.col("lang")))

    def centre(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("_h").slice(0, fit_rows)
        texts = table.column("text").combine_chunks()
        x = np.concatenate([_unit(features(texts.slice(at, _ROWS)), idf) for at in range(0, len(texts), _ROWS)])
        c = cluster(x, centroids)
        cos = x @ c.T
        own = np.argmax(cos, axis=1)
        reach = [float(np.quantile(cos[own == j, j], reject)) if (own == j).any() else 1.0 for j in range(len(c))]
        return pa.table({"lang": [key[0].as_py()] * len(c), "centroid": pa.array([r.astype(float) for r in c], pa.list_(pa.float64())), "reach": reach})

    rows = near.groupBy("lang").applyInArrow(centre, "lang string, centroid array<double>, reach double").collect()
    rows.sort(key=lambda r: (r.lang, r.centroid))
    return Model(idf, np.array([r.centroid for r in rows], np.float32), [r.lang for r in rows], np.array([r.reach for r in rows]))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, lang_pred, score, rejected`` for every row.

    ``score`` is the cosine to the nearest centroid; ``rejected`` says that
    it is further than that centroid's language reaches.  Null text and text
    without a letter are ``und`` with score 0, rejected; so is everything
    without a model.  Ties go to the language first in order.  Texts are
    read whole; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)  # languages x centroids x features, whatever the corpus
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in _blocks(batches):
            letter = pc.fill_null(pc.match_substring_regex(b.column("text"), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if model is None:
                letter = np.zeros(b.num_rows, bool)
            lang = np.full(b.num_rows, "und", object)
            score, rejected = np.zeros(b.num_rows), np.ones(b.num_rows, bool)
            if letter.any():
                cos = _unit(features(b.column("text").filter(pa.array(letter))), model.idf) @ model.centroids.T
                best = np.argmax(cos, axis=1)
                top = cos[np.arange(len(best)), best]
                lang[letter] = np.array(model.langs, object)[best]
                score[letter] = np.clip(top, 0, 1)
                rejected[letter] = top < model.reach[best]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        rows, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is kept from learning, by a checksum of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fitting) -> DataFrame:
    """Fit on the rows not held out that have a language, then predict every row (adds ``held_out``)."""
    prepare(docs.sparkSession)
    known = docs.where(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = predict(docs, fit(known, **fitting), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
