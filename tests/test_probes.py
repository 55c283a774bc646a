"""The latent study against numpy."""

import numpy as np
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from polysafe.operators import probes
from polysafe.plans.adapters import activations


@pytest.fixture(scope="module")
def fit(spark):
    return probes.fit_set(probes.every_fourth_layer(activations(spark, SF01))).cache()


def test_fit_set_is_balanced_within_layers(fit):
    rows = fit.groupBy("layer").pivot("harmful", [0, 1]).count().collect()
    assert len(rows) == 3 and all(r["0"] == r["1"] > 0 for r in rows)
    assert fit.where("harmful <> refusal").isEmpty()
    assert fit.groupBy("layer", "language", "prompt_type", "harmful").count().agg(F.max("count")).first()[0] <= probes.FIT_PER_LANGUAGE


def test_every_fourth_layer(spark):
    df = spark.createDataFrame([(k,) for k in range(10)], "layer int")
    assert sorted(r.layer for r in probes.every_fourth_layer(df).collect()) == [1, 5, 9]


def test_components_and_projection(spark, fit):
    comps = probes.components(fit)
    acts = activations(spark, SF01)
    got = {r.prompt_id: (r.x, r.y) for r in probes.project(acts, comps).collect()}
    assert len(got) == acts.count()
    rows, own = acts.toPandas(), fit.toPandas()
    for layer in (27, 23, 19):
        x = np.stack(own[own.layer == layer].vec).astype(float)
        mean = x.mean(axis=0)
        v = np.linalg.svd(x - mean, full_matrices=False)[2][:2]
        v *= np.sign(v[np.arange(2), np.abs(v).argmax(axis=1)])[:, None]
        part = rows[rows.layer == layer]
        want = (np.stack(part.vec).astype(float) - mean) @ v.T
        assert np.allclose([got[i] for i in part.prompt_id], want, atol=1e-6)


def points(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    harmful, adversarial, layer = rng.integers(0, 2, (3, n))
    x, y = rng.normal(harmful * 1.5 + layer, 2), rng.normal(adversarial - harmful, 3)
    refusal = (rng.random(n) < 0.2 + 0.5 * harmful).astype(int)
    rows = [(int(k % 3), "adversarial" if a else "vanilla", int(h), int(r), float(u), float(v)) for k, (a, h, r, u, v) in enumerate(zip(adversarial, harmful, refusal, x, y))]
    return spark.createDataFrame(rows, "layer int, prompt_type string, harmful int, refusal int, x double, y double")


def objective(kind, x, s, w):
    m = s * (w[0] + x @ w[1:])
    return (np.log1p(np.exp(-np.abs(m))) + np.maximum(-m, 0) if kind == "logistic" else np.maximum(0, 1 - m)).sum() + 0.5 * (w[1:] ** 2).sum()


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_probes_reach_the_least_objective(spark, kind):
    rows = probes.probe_rows(points(spark, 200).coalesce(1), ["layer"]).cache()
    weights = probes.fit_probes(rows, kind)
    table = rows.toPandas()
    assert len(weights) == 21 == table.probe.nunique()
    rng = np.random.default_rng(0)
    for probe, part in table.groupby("probe"):
        x, s = part[["x_std", "y_std"]].to_numpy(), np.where(part.label == 1, 1.0, -1.0)
        assert np.allclose(x.mean(axis=0), 0, atol=1e-9) and np.allclose(x.std(axis=0), 1)
        best = objective(kind, x, s, weights[probe])
        for scale in (1.0, 0.1, 0.01, 0.001):
            for move in rng.normal(0, scale, (200, 3)):
                assert objective(kind, x, s, weights[probe] + move) > best - 2e-6 * (1 + best)


def test_hinge_probe_of_one_label_and_of_parted_labels(spark):
    rows = [("one", 1, float(k % 5), float(k % 3)) for k in range(30)] + [("parted", k % 2, (k % 2) * 8.0 + k % 3, float(k % 4)) for k in range(30)]
    df = spark.createDataFrame(rows, "probe string, label int, x_std double, y_std double")
    w = probes.fit_probes(df, "svm")
    assert objective("svm", np.array([r[2:] for r in rows[:30]]), np.ones(30), w["one"]) < 1e-6
    x, s = np.array([r[2:] for r in rows[30:]]), np.where([r[1] for r in rows[30:]], 1.0, -1.0)
    best = objective("svm", x, s, w["parted"])
    assert best < 0.1 and ((w["parted"][0] + x @ w["parted"][1:]) * s > 0.9).all()
    assert probes.fit_probes(df.where("false"), "svm") == {}


def test_metrics_and_grid(spark):
    p = points(spark)
    got = probes.probe_metrics(p, ["layer"]).collect()
    assert len(got) == 21
    rows = probes.probe_rows(p, ["layer"]).toPandas()
    weights = probes.fit_probes(probes.probe_rows(p, ["layer"]).cache())
    for r in got:
        part = rows[(rows.layer == r.layer) & (rows.scope == r.scope) & (rows.target == r.target)]
        w = weights[f"{r.layer}|{r.scope}|{r.target}"]
        score = w[0] + part[["x_std", "y_std"]].to_numpy() @ w[1:]
        pos, neg = score[part.label == 1], score[part.label == 0]
        assert r.n == len(part) and r.accuracy == pytest.approx(((score > 0) == (part.label == 1)).mean())
        assert r.auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)), abs=1e-6)
    grid = probes.decision_grids(p, ["layer"]).toPandas()
    raw = p.toPandas()
    assert grid.groupby("layer").target.nunique().tolist() == [3, 3, 3]
    for layer, part in raw.groupby("layer"):
        g = grid[(grid.layer == layer) & (grid.target == "harmful")]
        gx, gy = np.arange(part.x.min() - 1, part.x.max() + 1), np.arange(part.y.min() - 1, part.y.max() + 1)
        assert len(g) == len(gx) * len(gy)
        w = weights[f"{layer}|all|harmful"]
        want = w[0] + w[1] * (g.gx - part.x.mean()) / part.x.std(ddof=0) + w[2] * (g.gy - part.y.mean()) / part.y.std(ddof=0)
        assert np.allclose(g.decision, want, atol=1e-4)
