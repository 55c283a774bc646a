"""Quality by the perplexity of a modified Kneser-Ney model of trusted text.

The model (``charlm``) has the 1- to 6-grams of bytes in Spark tables.  Trusted
texts are halved; a text is judged by the model of the half it is not in, so
limits and decisions come from text held out from training.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polysafe.llm.charlm import score, train
from polysafe.llm.common import discard, prepare, stored

#: A document passes if its perplexity lies between these quantiles of its language's trusted documents.
LOW, HIGH = 0.001, 0.98
_ACCURACY = 100_000


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quality_col: str = "quality", toxic_col: str = "toxic", low: float = LOW, high: float = HIGH,
) -> DataFrame:
    """``<id>, lang, perplexity, low, high, kept`` for every row.

    Trusted are documents that ``labels`` calls good and not toxic.  A
    language without trusted documents, or null, takes the quantiles of all
    trusted ones; with no trusted text at all everything is kept.  Null or
    empty text has a null perplexity and is not kept.  Rows that share an id
    are judged each; a null id is never trusted; other columns are ignored;
    an empty table gives no rows.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    good = labels.where((F.col(quality_col) == 1) & (F.coalesce(F.col(toxic_col), F.lit(0)) == 0)).select(F.col(id_col).cast("long").alias("id")).distinct()
    # The labels grow with the documents, so this join moves both sides at any size.
    learnt = stored(source.where("text <> ''").select("id", "text").join(good.hint("merge"), "id", "left_semi").select("text"), "trusted")
    untaught = learnt.isEmpty()
    if untaught:
        scored = source.select("id", "lang", F.lit(None).cast("double").alias("perplexity"))
    else:
        model = train(learnt)
        scored = score(source, model)
    discard(learnt)
    trusted = scored.where("perplexity is not null").join(good.hint("merge"), "id", "left_semi")
    quantiles = F.percentile_approx("perplexity", F.array(F.lit(low), F.lit(high)), F.lit(_ACCURACY)).alias("q")
    by_lang = trusted.where("lang is not null").groupBy("lang").agg(quantiles)
    overall = trusted.agg(quantiles).first()[0] or [0.0, float("inf")]
    limits = {r.lang: r.q for r in by_lang.collect()}  # one row a language
    bound = [F.lit(x) for x in overall]
    if limits:
        for k in (0, 1):
            table = F.create_map(*[F.lit(x) for lang, q in limits.items() for x in (lang, q[k])])
            bound[k] = F.coalesce(F.element_at(table, F.col("lang")), bound[k])
    empty = F.col("perplexity").isNull()
    if untaught:
        kept = F.lit(True)
    else:
        kept = ~empty & F.col("perplexity").between(F.col("low"), F.col("high"))
    return scored.select(F.col("id").alias(id_col), "lang", "perplexity", bound[0].alias("low"), bound[1].alias("high")).withColumn("kept", kept)
