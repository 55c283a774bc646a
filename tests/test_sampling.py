"""Sampling: exactness against pandas brute force, skew, disjointness."""

import hashlib

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF01
from polysafe.operators import corpus, sampling, selection


def _h(key, seed=42):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


def _brute_first_k(pdf, group, key, quota):
    pdf = pdf.assign(_h=pdf[key].map(_h)).sort_values(["_h", key])
    return set(pdf.groupby(group, group_keys=False).apply(lambda g: g.head(quota(g.name, len(g))), include_groups=False)[key])


@pytest.fixture(scope="module")
def skewed(spark):
    # one group holds a third of the rows
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 17}") for i in range(6000)]
    return spark.createDataFrame(rows, "id long, g string")


def test_first_k_fraction_exact_on_skew(spark, skewed):
    got = {r[0] for r in sampling.sample_fraction(skewed, ["g"], 0.1, "id").select("id").collect()}
    pdf = skewed.toPandas()
    assert got == _brute_first_k(pdf, "g", "id", lambda g, n: int(n * 0.1))


def test_per_group_and_global(spark, skewed):
    pdf = skewed.toPandas()
    got = {r[0] for r in sampling.sample_per_group(skewed, ["g"], 7, "id").select("id").collect()}
    assert got == _brute_first_k(pdf, "g", "id", lambda g, n: 7)
    glob = [r[0] for r in sampling.sample_global(skewed, 25, "id").select("id").collect()]
    assert glob == list(pdf.assign(_h=pdf.id.map(_h)).sort_values(["_h", "id"]).id[:25])


def test_ceil_and_key_order(spark, skewed):
    got = sampling.sample_ceil(skewed, 0.013, "id").count()
    assert got == -(-6000 * 13 // 1000)
    k = spark.createDataFrame([("hot", 5), ("g1", 3)], "g string, k long")
    rows = selection.first_by_order(skewed.where(F.col("g").isin("hot", "g1")), ["g"], k, "id").collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["id"])
    assert sorted(by["hot"]) == [0, 3, 6, 9, 12]
    assert sorted(by["g1"]) == [1, 35, 52]  # 18 belongs to the hot group


def test_strict_group_too_small(spark, skewed):
    with pytest.raises(Exception):
        sampling.sample_per_group(skewed, ["g"], 1000, "id", strict=True).collect()


def test_balanced_classes(spark):
    rows = [(i, "harmful" if i < 50 else "harmless", 1 if i % 2 else 0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, kind string, cls int")
    out = sampling.balanced_classes(df, "kind", "cls", {"harmful": 1, "harmless": 0}, "id").toPandas()
    assert out.groupby("kind").size().to_dict() == {"harmful": 25, "harmless": 25}
    assert sorted(out[out.kind == "harmless"].id) == list(range(50, 100, 2))


@settings(max_examples=5, deadline=None)
@given(st.integers(min_value=1, max_value=4), st.floats(min_value=0.05, max_value=0.3))
def test_split_subsets_disjoint_by_text(spark_session_for_hypothesis, n_safety, fraction):
    spark = spark_session_for_hypothesis
    from polysafe.plans.queries import train_corpus
    c = train_corpus(spark, "/root/testdata/sf0.001").select(
        F.concat_ws(":", F.col("safety").cast("string"), F.col("prompt_id").cast("string")).alias("row_key"),
        "safety", "category", "text")
    out = corpus.split_subsets(c, n_safety, fraction).join(c.select("row_key", "text"), "row_key").toPandas()
    out["subset"] = out.lg_subset.map(lambda a: ",".join(a))
    texts = out.groupby("subset").text.apply(set).to_dict()
    subsets = list(texts)
    for i in range(len(subsets)):
        for j in range(i + 1, len(subsets)):
            assert not (texts[subsets[i]] & texts[subsets[j]])
    assert len(out) <= c.count()


def test_first_k_quota_edges(spark, skewed):
    k = spark.createDataFrame([("g1", 10_000), ("g2", 0)], "g string, k long")
    out = sampling.first_k_by_hash(skewed, ["g"], k, "id").groupBy("g").count().collect()
    got = {r["g"]: r["count"] for r in out}
    assert got == {"g1": skewed.where("g = 'g1'").count()}  # whole group; g2 quota 0; others no quota


def test_split_subsets_quotas_exact(spark):
    from polysafe.plans.queries import train_corpus
    c = train_corpus(spark, "/root/testdata/sf0.01").select(
        F.concat_ws(":", F.col("safety").cast("string"), F.col("prompt_id").cast("string")).alias("row_key"),
        "safety", "category", "text")
    out = corpus.split_subsets(c, 3, 0.1).toPandas()
    out["subset"] = out.lg_subset.map(lambda a: ",".join(a))
    base = c.toPandas()
    first = out[out.subset == "fr,zh,lo,pag,en"]
    # safety: min(n, group size); instruction: floor(count * p) from the first counts
    for cat, g in base.groupby("category"):
        got = (first.category == cat).sum()
        want = min(3, len(g)) if g.safety.iloc[0] == 1 else int(len(g) * 0.1)
        assert got == want, (cat, got, want)
    assert len(out) <= len(base)
