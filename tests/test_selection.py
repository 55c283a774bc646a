"""Order statistics by refinement against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from polysafe.operators import profile, selection


def frame(spark):
    rng = random.Random(4)
    rows = [("out", float(k) if k else 1e300) for k in range(3000)]  # one outlier
    rows += [("cont", rng.lognormvariate(0, 8)) for _ in range(3000)] + [("ties", float(rng.choice([1, 1, 1, 2, 9]))) for _ in range(3000)]
    rows += [("one", 5.0)] * 2500 + [("few", 1.0), ("few", 2.0), ("null", None)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id int, g string, v double").repartition(4).cache()


@pytest.mark.parametrize("small", [20, 10_000])
def test_values_at_ranks(spark, small):
    rows, df = frame(spark)
    by = {g: sorted(v for h, v in rows if h == g and v is not None) for g in {g for g, _ in rows}}
    want = [(g, t, r) for g in by for t, r in enumerate((1, 2, 700, 701, 2999, 3000, 0, 99_999))]
    got = selection.values_at(df, ["g"], "v", spark.createDataFrame(want, "g string, target int, rank int"), splits=8, small=small).collect()
    assert sorted(map(tuple, got)) == sorted((g, t, by[g][r - 1], sum(v < by[g][r - 1] for v in by[g])) for g, t, r in want if 1 <= r <= len(by[g]))


def test_text_and_no_groups(spark):
    words = [f"w{k * 7919 % 1000:04d}" for k in range(1000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    got = selection.values_at(df, [], "w", spark.createDataFrame([(0, 1), (1, 500), (2, 1000)], "target int, rank int"), splits=8, small=10).collect()
    assert sorted((r.target, r.value, r.below) for r in got) == [(0, "w0000", 0), (1, "w0499", 499), (2, "w0999", 999)]


def test_an_outlier_leaves_few_rows_to_a_task(spark, monkeypatch):
    # one row far out: everything else would share one of any number of equal ranges
    monkeypatch.setattr(selection, "SMALL", 500)
    rows = spark.range(20_000).selectExpr("'a' AS g", "if(id = 77, 9223372036854775807, id) AS k", "id")
    seen = []
    real = selection.cut_lineage

    def noted(df):
        out = real(df)
        if "_stuck" in out.columns:
            seen.append(out.agg(F.max("_n")).first()[0])
        return out

    monkeypatch.setattr(selection, "cut_lineage", noted)
    got = selection.first_by_order(rows, ["g"], 7000, "k").agg(F.count("*"), F.max("k"), F.min("k")).first()
    assert got[:] == (7000, 7000, 0)
    assert seen[0] == 20_000 and seen[1] < 2000 and seen[-1] <= 500


def test_equal_rows_and_missing_keys(spark):
    df = spark.createDataFrame([("a", 1)] * 5 + [("a", 2)] * 5 + [("a", None)] * 3 + [("b", 4)], "g string, k int")
    count = lambda k: {(r.g, r.k): r["count"] for r in selection.first_by_order(df, ["g"], k, "k").groupBy("g", "k").count().collect()}
    assert count(7) == {("a", 1): 5, ("a", 2): 2, ("b", 4): 1}
    assert count(50) == {("a", 1): 5, ("a", 2): 5, ("b", 4): 1}
    assert count(0) == {}


def test_quantiles_of_continuous_values(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(selection, "SMALL", 50)
    rows, df = frame(spark)
    got = {r.g: r for r in profile.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75]).collect()}
    for g in ("out", "cont", "ties", "one", "few"):
        want = np.quantile([v for h, v in rows if h == g and v is not None], [0.25, 0.5, 0.75])
        assert np.allclose([got[g].q25, got[g].q50, got[g].q75], want, rtol=1e-12)
    assert "null" not in got
