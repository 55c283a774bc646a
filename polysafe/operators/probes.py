"""The latent study: projections and linear probes for many groups at once.

A group is a layer, or a language and layer; their number is a dimension of
the study, whatever the number of rows.  The projections are fitted on a
bounded draw, a task a layer; each step of a probe's solver is one aggregation
over all groups (slopes and curvatures, or cutting planes, at a few points a
probe).  Only these sums reach the driver, which solves systems of three or
four unknowns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polysafe.operators import sampling
from polysafe.operators.vectors import as_double_array, auc_rank, dot
from polysafe.session import cut_lineage, join_checked, ship_package

#: Rows per language, prompt type and kind that the fit set is drawn from.
FIT_PER_LANGUAGE = 30
#: (rows, label) of the seven probes of a group.
TARGETS = [("all", "harmful"), ("all", "form"), ("all", "refusal"), ("vanilla", "harmful"), ("vanilla", "refusal"),
           ("adversarial", "harmful"), ("adversarial", "refusal")]
LABELS = {"harmful": "harmful", "form": "CAST(prompt_type = 'adversarial' AS INT)", "refusal": "refusal"}


def every_fourth_layer(acts: DataFrame) -> DataFrame:
    """Layers last, last - 4, last - 8, ..."""
    last = acts.agg(F.max("layer").alias("last")).scalar()
    return acts.withColumn("_last", last).where((F.col("_last") - F.col("layer")) % 4 == 0).drop("_last")


def fit_set(acts: DataFrame) -> DataFrame:
    """Refused harmful and answered harmless rows of all languages, as many of each within a layer.

    Drawn from ``FIT_PER_LANGUAGE`` rows per layer, language, prompt type and kind.
    """
    drawn = sampling.sample_per_group(acts, ["layer", "language", "prompt_type", "harmful"], FIT_PER_LANGUAGE, "prompt_id")
    wanted = drawn.where(F.col("harmful") == F.col("refusal"))
    k = wanted.groupBy("layer").agg(F.least(F.count_if(F.col("harmful") == 1), F.count_if(F.col("harmful") == 0)).alias("_k"))
    order = Window.partitionBy("layer", "harmful").orderBy("prompt_id")
    ranked = wanted.withColumn("_rn", F.row_number().over(order))  # groups bounded by the draw
    return ranked.join(k, "layer").where("_rn <= _k").drop("_rn", "_k")


def components(fit: DataFrame, k: int = 2) -> DataFrame:
    """``layer, mean, loadings``: the leading principal axes of each layer's fit rows.

    A component's sign makes its loading of largest magnitude positive.  The
    fit set has a stated number of rows a layer (``fit_set``), so a layer is
    one task's worth: it sends d numbers a component, never d^2 moments, and
    nothing but that reaches anyone else.
    """
    ship_package(fit.sparkSession)

    def axes(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        flat = table["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.reshape(table.num_rows, -1)
        mean = x.mean(axis=0)
        vectors = np.linalg.svd(x - mean, full_matrices=False)[2][:k]
        signs = np.sign(vectors[np.arange(len(vectors)), np.argmax(np.abs(vectors), axis=1)])
        loadings = (vectors * signs[:, None]).tolist()
        return pa.table({"layer": pa.array([key[0].as_py()], pa.int32()), "mean": [mean.tolist()], "loadings": [loadings]})

    rows = fit.select(F.col("layer").cast("int"), as_double_array(F.col("vec")).alias("vec"))
    return cut_lineage(rows.groupBy("layer").applyInArrow(axes, "layer int, mean array<double>, loadings array<array<double>>"))


def project(acts: DataFrame, comps: DataFrame) -> DataFrame:
    """``x, y``: every row on its layer's two components, centred at the fit set's mean."""
    d = acts.withColumn("_v", as_double_array(F.col("vec"))).join(F.broadcast(comps), "layer")  # one row a layer
    d = d.withColumn("_c", F.zip_with("_v", "mean", lambda a, b: a - b))
    return d.withColumns({c: dot(F.col("_c"), F.col("loadings")[j]) for j, c in enumerate("xy")}).drop("_v", "_c", "mean", "loadings", "vec")


def standardized(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``x_std, y_std`` by population mean and deviation of each group."""
    stats = points.groupBy(*groups).agg(*[f(c).alias(f"_{n}_{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    d = join_checked(points, stats, list(groups))  # one row a group: the points need not move
    return d.withColumns({f"{c}_std": F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")) for c in "xy"}).drop(
        *[f"_{n}_{c}" for c in "xy" for n in "ms"])


def probe_rows(points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """A row of each point for each probe it belongs to: groups, ``scope, target, label``, standardised within the scope."""
    probes = F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(t).alias("target"), F.expr(LABELS[t]).cast("int").alias("label")) for s, t in TARGETS])
    own = F.filter(probes, lambda p: p["scope"].isin("all") | (p["scope"] == F.col("prompt_type")))
    rows = points.select(*groups, "x", "y", F.inline(own)).where("label IS NOT NULL")
    return standardized(rows, [*groups, "scope", "target"]).select(
        F.concat_ws("|", *groups, "scope", "target").alias("probe"), *groups, "scope", "target", "label", "x_std", "y_std")


def _margins(rows: DataFrame, weights: dict[str, np.ndarray], names: Sequence[str]) -> DataFrame:
    """Rows with their probe's weights as columns (one row a probe is broadcast)."""
    table = pa.table({"probe": list(weights), **{n: [float(w[k]) for w in weights.values()] for k, n in enumerate(names)}})
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table)), "probe")


#: Points of every probe that one aggregation evaluates.
_NEWTON_STEPS = [1.0, 0.5, 0.1]
_BUNDLE_STEPS = [0.02, 0.1, 0.25, 0.5, 0.75, 1.0, 1.15, 1.4]
#: A hinge solution's objective is within this share of the least one.
HINGE_GAP = 1e-6


def _sums_at(rows: DataFrame, points: dict[str, list[np.ndarray]], kind: str) -> dict[str, np.ndarray]:
    """One aggregation over all rows of the probes: what the loss is like at each of a probe's points.

    A row of sums a point.  ``logistic``: loss, three slopes, six curvatures.
    ``svm``: the plane under the summed hinge at that point, that is its value
    at 0 and three slopes, from the rows within the margin.
    """
    n = len(next(iter(points.values())))
    names = [f"{c}{k}" for k in range(n) for c in ("b", "wx", "wy")]
    d = _margins(rows, {p: np.concatenate(w) for p, w in points.items()}, names).withColumn("_s", F.expr("IF(label = 1, 1D, -1D)"))
    # as SQL text: a step is a hundred terms, and built one by one they take longer than the pass
    d = d.selectExpr("probe", "_s", "x_std", "y_std", *(f"_s * (b{k} + wx{k} * x_std + wy{k} * y_std) AS m{k}" for k in range(n)))
    feats = ["1D", "x_std", "y_std"]
    if kind == "svm":
        terms = [t for k in range(n) for t in (f"IF(m{k} < 1, 1D, 0D)", *(f"IF(m{k} < 1, -_s * {f}, 0D)" for f in feats))]
    else:
        d = d.selectExpr("*", *(f"1 / (1 + exp(m{k})) AS p{k}" for k in range(n)))
        bends = [f"{feats[i]} * {feats[j]}" for i in range(3) for j in range(i, 3)]
        terms = [t for k in range(n) for t in (f"log1p(exp(-abs(m{k}))) + greatest(-m{k}, 0D)", *(f"-p{k} * _s * {f}" for f in feats),
                                               *(f"p{k} * (1 - p{k}) * {f}" for f in bends))]
    cols = [F.expr(f"sum({t}) AS s{k}") for k, t in enumerate(terms)]
    return {r.probe: np.array(r[1:], float).reshape(n, -1) for r in d.groupBy("probe").agg(*cols).collect()}


def _pull(w: np.ndarray) -> float:
    return 0.5 * float(w[1] ** 2 + w[2] ** 2)


def _fit_logistic(rows: DataFrame, probes: list[str], rounds: int = 60) -> dict[str, np.ndarray]:
    """Newton's method for all probes together: the sums that judge a step also give the next one, so a step is one pass."""
    ridge = np.diag([1e-9, 1.0, 1.0])
    weights = {p: np.zeros(3) for p in probes}
    moves = {p: np.zeros(3) for p in probes}
    costs = {p: np.inf for p in probes}
    for _ in range(rounds):
        tried = {p: [weights[p] + t * moves[p] for t in _NEWTON_STEPS] for p in moves}
        left = {}
        for p, found in _sums_at(rows, tried, "logistic").items():
            cost = np.array([float(f[0]) + _pull(w) for f, w in zip(found, tried[p])])
            blur = 1e-10 * (1 + cost.min())  # sums of another order differ by so much
            if cost.min() > costs[p] + blur:
                left[p] = moves[p] * 0.05  # too long still
                continue
            best = int(np.argmax(cost <= cost.min() + blur))
            weights[p], costs[p] = tried[p][best], cost[best]
            grad = found[best][1:4] + [0.0, *weights[p][1:]]
            hess = np.zeros((3, 3))
            hess[np.triu_indices(3)] = found[best][4:]
            hess = hess + np.triu(hess, 1).T + ridge
            move = -np.linalg.solve(hess, grad)
            if -grad @ move > 1e-12 * (1 + costs[p]):
                left[p] = move
            else:
                weights[p] = weights[p] + move  # its error is of the square of this step
        if not left:
            break
        moves = left
    return weights


def _lowest(planes: np.ndarray, most: int = 50) -> np.ndarray:
    """argmin over (b, wx, wy) of |w|^2 / 2 + max(0, highest plane): interior-point steps on four unknowns.

    ``planes`` has a row (value at 0, three slopes) each.
    """
    scale = max(float(np.abs(planes).max()), 1e-300)
    q = planes / scale
    a = np.vstack([np.c_[-q[:, 1:], np.ones(len(q))], [0.0, 0.0, 0.0, 1.0]])
    b = np.r_[q[:, 0], 0.0]
    quad, lin = np.diag([1e-12, 1 / scale, 1 / scale, 0.0]), np.array([0.0, 0.0, 0.0, 1.0])
    v = np.array([0.0, 0.0, 0.0, b.max() + 1])
    y, z = a @ v - b, np.full(len(b), 1 / len(b))

    def room(x: np.ndarray, dx: np.ndarray) -> float:
        down = dx < 0
        return min(1.0, float((-x[down] / dx[down]).min())) if down.any() else 1.0

    for _ in range(most):
        off, gap, mu = quad @ v + lin - a.T @ z, a @ v - y - b, float(y @ z) / len(b)
        if mu < 1e-13:
            break
        system = quad + a.T @ ((z / y)[:, None] * a)
        system += np.diag(np.diag(system)) * 1e-13

        def towards(product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            dv = np.linalg.solve(system, -off - a.T @ ((product + z * gap) / y))
            dy = a @ dv + gap
            return dv, dy, -(product + z * dy) / y

        dv, dy, dz = towards(y * z)
        far = min(room(y, dy), room(z, dz))
        centre = (float((y + far * dy) @ (z + far * dz)) / len(b) / mu) ** 3
        dv, dy, dz = towards(y * z + dy * dz - centre * mu)
        step = 0.995 * min(room(y, dy), room(z, dz))
        v, y, z = v + step * dv, y + step * dy, z + step * dz
    return v[:3]


def _fit_hinge(rows: DataFrame, probes: list[str], gap: float = HINGE_GAP, rounds: int = 200) -> dict[str, np.ndarray]:
    """Cutting planes for all probes together: each pass gives the planes at several points between the best one and the lowest of the model.

    The model (the highest plane) lies under the summed hinge everywhere, so
    its least value bounds the least objective: a probe is done when its best
    point comes within ``gap`` of that bound.  Nothing is smoothed.
    """
    best = {p: np.zeros(3) for p in probes}
    costs = {p: np.inf for p in probes}
    planes: dict[str, np.ndarray] = {p: np.zeros((0, 4)) for p in probes}
    tried = {p: [np.zeros(3)] * len(_BUNDLE_STEPS) for p in probes}
    for _ in range(rounds):
        left = {}
        for p, found in _sums_at(rows, tried, "svm").items():
            planes[p] = np.unique(np.vstack([planes[p], found]), axis=0)
            for w, f in zip(tried[p], found):
                cost = float(f[0] + f[1:] @ w) + _pull(w)
                if cost < costs[p]:
                    best[p], costs[p] = w, cost
            low = _lowest(planes[p])
            bound = max(0.0, float((planes[p] @ np.r_[1.0, low]).max())) + _pull(low)
            if costs[p] - bound > gap * (1 + abs(costs[p])):
                left[p] = [best[p] + t * (low - best[p]) for t in _BUNDLE_STEPS]
        if not left:
            break
        tried = left
    return best


def fit_probes(rows: DataFrame, kind: str = "logistic") -> dict[str, np.ndarray]:
    """(intercept, w_x, w_y) of every probe: sum of losses + |w|^2 / 2, the intercept free.

    All probes are fitted together, one aggregation a step; only sums (three
    dozen numbers a probe) reach the driver.  ``svm`` is the hinge itself.
    """
    if kind not in ("logistic", "svm"):
        raise NotImplementedError(kind)
    probes = sorted(r.probe for r in rows.select("probe").distinct().collect())
    if not probes:
        return {}
    return _fit_logistic(rows, probes) if kind == "logistic" else _fit_hinge(rows, probes)


def probe_metrics(points: DataFrame, groups: Sequence[str], kind: str = "logistic") -> DataFrame:
    """``groups, scope, target, n, accuracy, auc`` of the seven probes of every group, in sample.

    A probe whose rows have one label only is fitted all the same; its auc is null.
    """
    rows = cut_lineage(probe_rows(points, groups))
    names = ["b", "wx", "wy"]
    d = _margins(rows, fit_probes(rows, kind), names)
    d = d.withColumn("score", F.col("b") + F.col("wx") * F.col("x_std") + F.col("wy") * F.col("y_std"))
    d = cut_lineage(d.select("probe", *groups, "scope", "target", "label", "score"))
    hit = (F.col("score") > 0).cast("int") == F.col("label")
    acc = d.groupBy("probe", *groups, "scope", "target").agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("accuracy"))
    auc = auc_rank(d, "score", "label", "probe").select("probe", "auc")
    return acc.join(auc, "probe", "left").drop("probe")


def _ticks(axis: str) -> Column:
    """Unit steps from one below the least value to one above the greatest (left out itself)."""
    low, high = F.col(f"lo_{axis}"), F.col(f"hi_{axis}")
    return F.transform(F.sequence(F.lit(0), F.ceil(high - low + 2).cast("int") - 1), lambda k: low - 1 + k)


def decision_grids(points: DataFrame, groups: Sequence[str], kind: str = "logistic") -> DataFrame:
    """``groups, target, gx, gy, decision``: the three boundaries over a unit mesh around each group's points.

    The mesh has a point per unit square of the points' bounding box, so its size goes with their spread, not their number.
    """
    rows = cut_lineage(probe_rows(points, groups).where("scope = 'all'"))
    weights = fit_probes(rows, kind)
    ids = rows.select("probe", *groups, "target").distinct()
    stats = points.groupBy(*groups).agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    lines = _margins(stats.join(ids, list(groups)), weights, ["b", "wx", "wy"])
    mesh = lines.withColumn("gx", F.explode(_ticks("x"))).withColumn("gy", F.explode(_ticks("y")))
    value = F.col("b") + sum((F.col(f"w{c}") * F.try_divide(F.col(f"g{c}") - F.col(f"m_{c}"), F.col(f"s_{c}")) for c in "xy"), F.lit(0.0))
    return mesh.select(*groups, "target", "gx", "gy", value.alias("decision"))
