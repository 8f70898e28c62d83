"""SQL text for least squares and ridge of groups of columns, by Gauss-Jordan elimination over lists."""

from __future__ import annotations


def elimination(name: str, start: str) -> str:
    """A recursive query over start (keys, m): m, a square matrix with further columns, becomes the identity with the solutions."""
    return f"""{name} AS (SELECT *, 1 AS k FROM {start} UNION ALL SELECT * EXCLUDE (m, k),
  list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k THEN list_transform(m[k], lambda x: x / m[k][k])
    ELSE list_transform(range(1, len(m[1]) + 1), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END) AS m, k + 1 FROM {name} WHERE k <= len(m))"""


def scored(rows: str, key: str, xs: list[str], y: str, groups: dict[str, list[str]], alpha: float, tag: str = "") -> str:
    """CTEs that end in scored{tag} (g, name, y, yhat): test rows of `rows` (key, role, xs, y; none null) by the fit of each group on the training rows of their key."""
    f, n = ", ".join(xs), len(xs)
    means = ", ".join(f"avg(f[{i + 1}])" for i in range(n + 1))
    values = ", ".join(f"('{name}', [{', '.join(str(xs.index(c) + 1) for c in cols)}])" for name, cols in groups.items())
    t = tag
    return f"""feat{t} AS (SELECT {key} AS g, role, [{f}, {y}]::DOUBLE[] AS f FROM {rows}),
cells{t} AS (SELECT g, i, j, covar_pop(f[i], f[j]) AS v FROM feat{t} CROSS JOIN range(1, {n + 2}) AS a(i) CROSS JOIN range(1, {n + 2}) AS b(j) WHERE role = 'train' GROUP BY ALL),
matrix{t} AS (SELECT g, list(r ORDER BY i) AS c FROM (SELECT g, i, list(v ORDER BY j) AS r FROM cells{t} GROUP BY g, i) GROUP BY g),
centre{t} AS (SELECT g, count(*) AS n, [{means}] AS mu FROM feat{t} WHERE role = 'train' GROUP BY g),
groups{t}(name, ix) AS (VALUES {values}),
begin{t} AS (SELECT g, name, ix, mu, list_transform(ix, lambda a: list_append(list_transform(ix, lambda b: c[a][b] + CASE WHEN a = b THEN {float(alpha)!r} / n ELSE 0.0 END), c[a][{n + 1}])) AS m
  FROM matrix{t} JOIN centre{t} USING (g) CROSS JOIN groups{t}),
{elimination("solve" + t, "begin" + t)},
fit{t} AS (SELECT g, name, ix, b, mu[{n + 1}] - list_sum(list_transform(range(1, len(ix) + 1), lambda q: b[q] * mu[ix[q]])) AS a
  FROM (SELECT *, list_transform(m, lambda r: r[len(r)]) AS b FROM solve{t} WHERE k = len(m) + 1)),
scored{t} AS (SELECT g, name, f[{n + 1}] AS y, a + list_sum(list_transform(range(1, len(ix) + 1), lambda q: b[q] * f[ix[q]])) AS yhat FROM feat{t} JOIN fit{t} USING (g) WHERE role = 'test')"""
