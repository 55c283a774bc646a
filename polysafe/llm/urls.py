"""URL filtering by association rules over URL tokens (DataFrame functions and Spark ML only)."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polysafe.llm.common import prepare

# Fixed values: (host, path, verdict) of the listed rules.
LISTED = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: A mined rule must hold on this share of the labelled urls,
MIN_SUPPORT = 0.005
#: and be right this often.
MIN_CONFIDENCE = 0.9

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: float


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, _PARTS, 1), _UPPER, _UPPER.lower()), F.regexp_extract(u, _PARTS, 2)


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits, as (its text, its verdict); null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels, registered domain, path segments (digits as #) and query keys."""
    host, path = url_parts(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    query = F.filter(F.split(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)\?([^#]*)", 1), "&"), lambda x: x != "")
    return F.array_distinct(F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(host != "", F.array(F.concat(F.lit("domain:"), F.substring_index(host, ".", -2)))).otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(query, lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
    ))


def mine_rules(
    labelled: DataFrame, url_col: str = "url", label_col: str = "label",
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> list[Rule]:
    """Rules "these tokens, so this label" from every labelled url, best first.

    FP-growth runs over all labelled rows; rows with a null label are left
    out.  Rules below support or confidence go, and so does a rule whose
    tokens include those of a rule at least as confident with the same label.
    Ordered by confidence, support, fewer tokens, then text.
    """
    items = labelled.where(F.col(label_col).isNotNull()).select(
        F.concat(url_tokens(F.col(url_col)), F.array(F.concat(F.lit("label:"), F.col(label_col)))).alias("items"))
    if items.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(
        F.col("consequent")[0].startswith("label:") & ~F.exists("antecedent", lambda x: x.startswith("label:"))
    ).select(F.sort_array("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 1 << 20).alias("verdict"), "confidence", "support")
    best = found.orderBy(F.desc("confidence"), F.desc("support"), F.size("tokens"), F.concat_ws(" ", "tokens"), "verdict")
    kept: list[Rule] = []
    # The number of rules is bounded by the support: at most 1 / min_support frequent tokens per position of a url.
    for row in best.toLocalIterator():
        rule = Rule(tuple(row.tokens), row.verdict, row.confidence, row.support)
        if not any(k.verdict == rule.verdict and set(k.tokens) <= set(rule.tokens) for k in kept):
            kept.append(rule)
    return kept


def mined_verdict(url: Column, rules: list[Rule]) -> Column:
    """Verdict of the best mined rule whose tokens the url has all of; null where none fits.

    Inverted index: token -> numbers of the rules that have it.  A rule fits
    when as many of the url's tokens lead to it as it has tokens.
    """
    if not rules:
        return F.lit(None).cast("string")
    index: dict[str, list[int]] = {}
    for k, rule in enumerate(rules):
        for t in rule.tokens:
            index.setdefault(t, []).append(k)
    postings = F.from_json(F.lit(json.dumps(index)), "map<string,array<int>>")
    sizes = F.array(*[F.lit(len(r.tokens)) for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    hits = F.flatten(F.filter(F.transform(url_tokens(url), lambda t: F.element_at(postings, t)), lambda x: x.isNotNull()))
    fits = F.filter(F.array_distinct(hits), lambda r: F.size(F.filter(hits, lambda x: x == r)) == F.get(sizes, r))
    return F.get(verdicts, F.array_min(fits))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=LISTED, default: str = "allow", **mining) -> DataFrame:
    """``<id>, host, path, rule, verdict, mined`` for every row.

    The listed rules label the urls they fit; FP-growth mines token
    combinations from these labels, and the mined rules judge the other urls
    (``mined`` is their verdict or null, ``default`` holds where none fits).
    Null or malformed urls have empty host and path and get ``default``;
    repeated rows are judged each; an empty table gives no rows; other
    columns are ignored.
    """
    prepare(pages.sparkSession)
    url = F.col(url_col)
    host, path = url_parts(url)
    parts = pages.select(F.col(id_col).alias("_id"), url.alias("_url"), host.alias("host"), path.alias("path"))
    name, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.withColumns({"rule": name, "_label": verdict})
    mined = mine_rules(ruled, "_url", "_label", **mining)
    return ruled.withColumn("mined", F.when(F.col("_label").isNull(), mined_verdict(F.col("_url"), mined))).select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_label", "mined", F.lit(default)).alias("verdict"), "mined")
