"""DuckDB SQL of the latent study: principal axes by repeated squaring, probes by Newton steps, one CTE a step."""

from __future__ import annotations

from polysafe.operators.probes import FIT_PER_LANGUAGE, LABELS, TARGETS
from polysafe.plans.adapters import ACTIVATIONS_SQL

#: Squarings of a covariance: the leading axis stands out by (second / first eigenvalue) ^ 2^24.
SQUARINGS = 24
#: Newton steps from 0; far more than the quadratic convergence needs.
NEWTON_STEPS = 14


def _axis(name: str, matrix: str) -> list[str]:
    """CTEs ending in ``name`` (layer, i, v, value): the leading unit eigenvector of each layer's symmetric ``matrix`` (layer, i, j, v)."""
    out = [f"{name}_0 AS MATERIALIZED (SELECT layer, i, j, v / sum(v) FILTER (i = j) OVER (PARTITION BY layer) AS v FROM {matrix})"]
    for k in range(SQUARINGS):
        out.append(f"""{name}_{k + 1} AS MATERIALIZED (
  SELECT layer, i, j, v / sum(v) FILTER (i = j) OVER (PARTITION BY layer) AS v FROM (
    SELECT a.layer, a.i, b.j, sum(a.v * b.v) AS v FROM {name}_{k} a JOIN {name}_{k} b ON a.layer = b.layer AND a.j = b.i GROUP BY 1, 2, 3))""")
    last = f"{name}_{SQUARINGS}"
    out.append(f"""{name}_raw AS MATERIALIZED (SELECT m.layer, m.i, m.v FROM {last} m
  JOIN (SELECT layer, arg_max(i, v) AS top FROM {last} WHERE i = j GROUP BY layer) t ON m.layer = t.layer AND m.j = t.top)""")
    out.append(f"""{name}_long AS MATERIALIZED (
  SELECT m.layer, m.i, sum(m.v * r.v) AS v FROM {matrix} m JOIN {name}_raw r ON m.layer = r.layer AND m.j = r.i GROUP BY m.layer, m.i)""")
    out.append(f"""{name} AS MATERIALIZED (SELECT layer, i, v / sqrt(sum(v * v) OVER w) * sign(arg_max(v, abs(v)) OVER w) AS v
  FROM {name}_long WINDOW w AS (PARTITION BY layer))""")
    return out


def projection_ctes() -> list[str]:
    return [
        f"acts AS MATERIALIZED ({ACTIVATIONS_SQL})",
        f"""drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layer, language, prompt_type, harmful
  ORDER BY md5(concat_ws('|', prompt_id, '42')), prompt_id) AS rn FROM acts) WHERE rn <= {FIT_PER_LANGUAGE} AND harmful = refusal)""",
        """fit AS MATERIALIZED (SELECT d.* FROM (SELECT *, row_number() OVER (PARTITION BY layer, harmful ORDER BY prompt_id) AS at FROM drawn) d
  JOIN (SELECT layer, least(count(*) FILTER (harmful = 1), count(*) FILTER (harmful = 0)) AS k FROM drawn GROUP BY layer) c
  ON d.layer = c.layer AND d.at <= c.k)""",
        "cells AS (SELECT layer, prompt_id, unnest(range(len(vec))) AS i, unnest(vec)::DOUBLE AS v FROM fit)",
        "mean AS MATERIALIZED (SELECT layer, i, avg(v) AS v FROM cells GROUP BY layer, i)",
        "centred AS MATERIALIZED (SELECT c.layer, c.prompt_id, c.i, c.v - m.v AS v FROM cells c JOIN mean m ON c.layer = m.layer AND c.i = m.i)",
        """cov AS MATERIALIZED (SELECT a.layer, a.i, b.i AS j, sum(a.v * b.v) AS v FROM centred a
  JOIN centred b ON a.layer = b.layer AND a.prompt_id = b.prompt_id GROUP BY 1, 2, 3)""",
        *_axis("first", "cov"),
        """size AS (SELECT m.layer, sum(a.v * m.v * b.v) AS v FROM cov m JOIN first a ON a.layer = m.layer AND a.i = m.i
  JOIN first b ON b.layer = m.layer AND b.i = m.j GROUP BY m.layer)""",
        """rest AS MATERIALIZED (SELECT m.layer, m.i, m.j, m.v - s.v * a.v * b.v AS v FROM cov m JOIN size s ON s.layer = m.layer
  JOIN first a ON a.layer = m.layer AND a.i = m.i JOIN first b ON b.layer = m.layer AND b.i = m.j)""",
        *_axis("second", "rest"),
        """pts AS MATERIALIZED (SELECT a.prompt_id, a.language, a.layer, a.harmful, a.prompt_type, a.refusal,
    sum((a.v - m.v) * f.v) AS x, sum((a.v - m.v) * s.v) AS y
  FROM (SELECT * EXCLUDE (vec), unnest(range(len(vec))) AS i, unnest(vec)::DOUBLE AS v FROM acts) a
  JOIN mean m ON m.layer = a.layer AND m.i = a.i JOIN first f ON f.layer = a.layer AND f.i = a.i JOIN second s ON s.layer = a.layer AND s.i = a.i
  GROUP BY ALL)""",
    ]


def _std(c: str, window: str) -> str:
    return f"({c} - avg({c}) OVER {window}) / nullif(stddev_pop({c}) OVER {window}, 0)"


def probe_ctes(groups: list[str]) -> list[str]:
    """Down to ``w`` (groups, scope, target, b, wx, wy) and ``rows`` (the probes' standardised rows)."""
    keys = ", ".join([*groups, "scope", "target"])
    parts = " UNION ALL ".join(
        f"SELECT {', '.join(groups)}, '{s}' AS scope, '{t}' AS target, {LABELS[t]} AS label, x, y FROM pts"
        + ("" if s == "all" else f" WHERE prompt_type = '{s}'") for s, t in TARGETS)
    out = [f"raw AS ({parts})",
           f"""rows AS MATERIALIZED (SELECT {keys}, label, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS s,
  {_std('x', 'k')} AS x, {_std('y', 'k')} AS y FROM raw WHERE label IS NOT NULL WINDOW k AS (PARTITION BY {keys}))""",
           f"w_0 AS MATERIALIZED (SELECT {keys}, 0::DOUBLE AS b, 0::DOUBLE AS wx, 0::DOUBLE AS wy FROM rows GROUP BY {keys})"]
    for k in range(NEWTON_STEPS):
        # slopes and curvatures at the last weights, then the 3 x 3 system by cofactors
        out.append(f"""w_{k + 1} AS MATERIALIZED (
  WITH p AS (SELECT {keys}, b, wx, wy, s, x, y, 1 / (1 + exp(s * (b + wx * x + wy * y))) AS p FROM rows JOIN w_{k} USING ({keys})),
  t AS (SELECT {keys}, b, wx, wy, -sum(p * s) AS g0, -sum(p * s * x) + wx AS g1, -sum(p * s * y) + wy AS g2,
      sum(p * (1 - p)) + 1e-9 AS a, sum(p * (1 - p) * x) AS h, sum(p * (1 - p) * y) AS c,
      sum(p * (1 - p) * x * x) + 1 AS d, sum(p * (1 - p) * x * y) AS e, sum(p * (1 - p) * y * y) + 1 AS f FROM p GROUP BY {keys}, b, wx, wy),
  q AS (SELECT *, a * (d * f - e * e) - h * (h * f - e * c) + c * (h * e - d * c) AS det FROM t)
  SELECT {keys}, b - ((d * f - e * e) * g0 + (c * e - h * f) * g1 + (h * e - c * d) * g2) / det AS b,
    wx - ((c * e - h * f) * g0 + (a * f - c * c) * g1 + (h * c - a * e) * g2) / det AS wx,
    wy - ((h * e - c * d) * g0 + (h * c - a * e) * g1 + (a * d - h * h) * g2) / det AS wy FROM q)""")
    return out + [f"w AS (SELECT * FROM w_{NEWTON_STEPS})"]


def _r6(c: str) -> str:
    return f"round({c}, 6) + 0.0"


def _metrics(groups: list[str]) -> str:
    keys = ", ".join([*groups, "scope", "target"])
    ctes = [*projection_ctes(), *probe_ctes(groups),
            f"scored AS (SELECT {keys}, label, b + wx * x + wy * y AS score FROM rows JOIN w USING ({keys}))",
            f"""ranked AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS r FROM scored)"""]
    return f"""WITH {', '.join(ctes)}
SELECT {keys}, count(*) AS n, {_r6("avg(CASE WHEN (score > 0) = (label = 1) THEN 1.0 ELSE 0.0 END)")} AS accuracy,
  {_r6("(sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0)")} AS auc
FROM ranked GROUP BY {keys}"""


def _grid() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xy")
    ctes = [*projection_ctes(), *probe_ctes(["layer"]), f"st AS (SELECT layer, {stats} FROM pts GROUP BY layer)",
            "gx AS (SELECT *, lo_x - 1 + unnest(range(CAST(ceil(hi_x - lo_x + 2) AS INT))) AS gx FROM st)",
            "mesh AS (SELECT *, lo_y - 1 + unnest(range(CAST(ceil(hi_y - lo_y + 2) AS INT))) AS gy FROM gx)"]
    return f"""WITH {', '.join(ctes)}
SELECT layer, target, {_r6('gx')} AS gx, {_r6('gy')} AS gy, {_r6('b + wx * (gx - m_x) / s_x + wy * (gy - m_y) / s_y')} AS decision
FROM mesh JOIN (SELECT * FROM w WHERE scope = 'all') USING (layer)"""


_POINT = "prompt_id, language, layer, harmful, prompt_type, refusal"
PROBE_ORACLE = {
    "pca_projection": f"WITH {', '.join(projection_ctes())} SELECT {_POINT}, {_r6('x')} AS x, {_r6('y')} AS y FROM pts",
    "standardize_2d": f"""WITH {', '.join(projection_ctes())},
sc AS (SELECT *, unnest(['all', prompt_type]) AS scope FROM pts)
SELECT {_POINT}, scope, {_r6('x')} AS x, {_r6('y')} AS y, {_r6(_std('x', 'k'))} AS x_std, {_r6(_std('y', 'k'))} AS y_std
FROM sc WINDOW k AS (PARTITION BY language, layer, scope)""",
    "probe_metrics": _metrics(["layer"]),
    "layer_sweep": _metrics(["language", "layer"]),
    "decision_grid": _grid(),
}
