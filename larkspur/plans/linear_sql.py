"""DuckDB SQL that fits and scores the linear family by itself, to check the
fits from moments: least squares and ridge by Gauss-Jordan elimination, lasso by
coordinate descent, both as recursive queries over lists."""

from __future__ import annotations

from collections.abc import Sequence

LASSO_SWEEPS = 150


def fits(features: Sequence[str], variants: Sequence[tuple[str, str, float]], dropped: str | None = None) -> str:
    """CTEs ``moments`` and ``coef`` (task, variant, w, w0) from a CTE ``members``
    (task, y, the features): one fit per task and (variant, family, alpha).
    ``dropped`` is a feature that is a sum of the others and a constant: least
    squares leaves it out, which changes no prediction."""
    p = len(features)
    q = features.index(dropped) + 1 if dropped in features else 0
    solved = [(v, a if f == "ridge" else 0.0, q if f != "ridge" else 0) for v, f, a in variants if f != "lasso"]
    sparse = [(v, a) for v, f, a in variants if f == "lasso"]
    gram = ", ".join("[" + ", ".join(f"covar_pop({a}, {b}) * count(*)" for b in features) + "]" for a in features)
    out = f"""
moments AS MATERIALIZED (
  SELECT task, count(*) AS n, avg(y) AS my, [{', '.join(f'avg({a})' for a in features)}] AS mx, [{gram}] AS g,
         [{', '.join(f'covar_pop({a}, y) * count(*)' for a in features)}] AS t
  FROM members GROUP BY task),"""
    parts = []
    if solved:
        rows = ", ".join(f"('{v}', {a!r}::DOUBLE, {d})" for v, a, d in solved)
        out += f"""
solve(task, variant, k, m) AS (
  SELECT task, variant, 0, list_transform(range(1, {p + 1}), lambda i: list_concat(
           list_transform(range(1, {p + 1}), lambda j:
             CASE WHEN i = d OR j = d THEN (i = j)::INTEGER::DOUBLE ELSE g[i][j] + CASE WHEN i = j THEN alpha ELSE 0.0 END END),
           [CASE WHEN i = d THEN 0.0::DOUBLE ELSE t[i] END]))
  FROM moments, (VALUES {rows}) v(variant, alpha, d)
  UNION ALL
  SELECT task, variant, k + 1, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j:
           CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j] END))
  FROM solve WHERE k < {p}),"""
        parts.append(f"SELECT task, variant, list_transform(m, lambda r: r[{p + 1}]) AS w FROM solve WHERE k = {p}")
    if sparse:
        rows = ", ".join(f"('{v}', {a!r}::DOUBLE)" for v, a in sparse)
        out += f"""
descend(task, variant, alpha, k, w) AS (
  SELECT task, variant, alpha, 0, list_transform(range(0, {p}), lambda i: 0.0::DOUBLE)
  FROM moments, (VALUES {rows}) v(variant, alpha)
  UNION ALL
  SELECT task, variant, alpha, k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i <> k % {p} + 1 THEN w[i] ELSE
           sign(pull) * greatest(abs(pull) - n * alpha, 0.0) / g[i][i] END)
  FROM (SELECT d.*, m.n, m.g, m.t[k % {p} + 1] - list_dot_product(m.g[k % {p} + 1], w) + m.g[k % {p} + 1][k % {p} + 1] * w[k % {p} + 1] AS pull
        FROM descend d JOIN moments m ON d.task = m.task WHERE k < {p * LASSO_SWEEPS})),"""
        parts.append(f"SELECT task, variant, w FROM descend WHERE k = {p * LASSO_SWEEPS}")
    return out + f"""
coef AS MATERIALIZED (
  SELECT c.task, c.variant, c.w, m.my - list_dot_product(c.w, m.mx) AS w0, m.n
  FROM ({' UNION ALL '.join(parts)}) c JOIN moments m ON c.task = m.task)"""


def scores(held: str, by: str, features: Sequence[str], rows: str) -> str:
    """R2 and RMSE per ``by`` of ``coef`` on the rows of ``rows`` that ``held`` names."""
    return f"""
SELECT {by}, count(*) AS n, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse
FROM (SELECT c.*, r.y, c.w0 + {' + '.join(f'c.w[{i}] * r.{f}' for i, f in enumerate(features, 1))} AS p
      FROM {rows} r JOIN coef c ON {held}) GROUP BY {by}"""
