"""Vector analytics against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from polysafe.operators import vectors as vx
from polysafe.plans.adapters import activations


@pytest.fixture(scope="module")
def acts(spark):
    return activations(spark, SF01).toPandas()


def test_pca_fit_apply_matches_numpy(spark, acts):
    a = activations(spark, SF01)
    fit, app = a.where(F.col("language") == "en"), a.where(F.col("language") != "en")
    got = vx.pca_fit_apply(fit, app, "vec", 2).select("prompt_id", "pc").toPandas().sort_values("prompt_id")
    X = np.stack(acts[acts.language == "en"].vec.map(lambda v: np.asarray(v, dtype=float)).to_list())
    Y = acts[acts.language != "en"].sort_values("prompt_id")
    Yv = np.stack(Y.vec.map(lambda v: np.asarray(v, dtype=float)).to_list())
    mu = X.mean(axis=0)
    _, _, vt = np.linalg.svd(X - mu, full_matrices=False)
    comps = vt[:2].T
    for j in range(2):
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] *= -1
    want = (Yv - mu) @ comps
    np.testing.assert_allclose(np.stack(got.pc.to_list()), want, rtol=1e-6, atol=1e-6)


def test_ablation_removes_direction(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 0.0])], "a array<double>, d array<double>")
    d = vx.with_unit(df, "d", "u")
    d = vx.with_ablation(d, "a", "u", "ab")
    d = vx.with_patch(d, "a", "u", 2.0, "p").withColumn("s", vx.add(F.col("a"), F.col("d"), 0.5))
    r = d.first()
    assert r["ab"] == pytest.approx([3.0 - 3.0 / (1 + 1e-8) ** 2, 4.0])
    assert r["p"][0] == pytest.approx(2.0, abs=1e-6)
    assert r["s"] == pytest.approx([3.5, 4.0])


def test_auc_rank_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    scores = rng.integers(0, 20, 400).astype(float)  # many ties
    labels = (rng.random(400) < 0.4).astype(int)
    groups = np.where(rng.random(400) < 0.5, "a", "b")
    df = spark.createDataFrame([(g, float(s), int(y)) for g, s, y in zip(groups, scores, labels)],
                               "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in vx.auc_rank(df, "s", "y", "g", n_parts=5).collect()}
    for g in ("a", "b"):
        s, y = scores[groups == g], labels[groups == g]
        pos, neg = s[y == 1], s[y == 0]
        want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
        assert got[g] == pytest.approx(want, abs=1e-12)


def _np_logistic(X, y, C=1.0, iters=100):
    Xb = np.hstack([X, np.ones((len(X), 1))])
    w = np.zeros(Xb.shape[1])
    reg = np.eye(Xb.shape[1]) / C
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ w))
        g = Xb.T @ (p - y) + reg @ w
        H = Xb.T @ (Xb * (p * (1 - p))[:, None]) + reg
        w -= np.linalg.solve(H, g)
    return w


def test_logistic_probe_matches_c1_objective(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(300, 2))
    y = (X[:, 0] + 0.5 * X[:, 1] + rng.normal(scale=0.8, size=300) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(X, y)], "x double, z double, y double")
    model, pred = vx.fit_probe(df, ["x", "z"], "y")
    w = _np_logistic(X, y)
    np.testing.assert_allclose(model.coefficients.toArray(), w[:2], rtol=1e-4, atol=1e-5)
    assert model.intercept == pytest.approx(w[2], abs=1e-5)
    acc = vx.accuracy(pred)
    p = 1 / (1 + np.exp(-(X @ w[:2] + w[2])))
    assert acc == pytest.approx(((p > 0.5) == y).mean())


def test_standardize_population(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("t", 5.0), ("t", 5.0)], "scope string, x double")
    out = {(r["scope"], r["x"]): r["x_std"] for r in vx.standardize(df, ["x"], ["scope"]).collect()}
    assert out[("s", 1.0)] == pytest.approx(-1.0)
    assert out[("t", 5.0)] is None  # zero variance
