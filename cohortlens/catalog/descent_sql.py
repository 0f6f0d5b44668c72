"""SQL twins of penalised least squares: coordinate descent, one recursive step for each coordinate."""

from __future__ import annotations

from collections.abc import Sequence


def scaled(role: str, cols: Sequence[str], y: str = "y", imputed: bool = True) -> str:
    """CTEs ``sc``, ``z`` and ``mo``: means and sds, imputed and scaled rows (columns z0.., y last as it is), means of rows."""
    p = len(cols)
    mean = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(cols))
    sd = ", ".join(f"CASE WHEN stddev_pop(coalesce({c}, m{i})) > 1e-12 THEN stddev_pop(coalesce({c}, m{i})) ELSE 1 END AS s{i}" for i, c in enumerate(cols))
    keep = ", ".join(f"any_value(m{i}) AS m{i}" for i in range(p))
    rows = ", ".join(f"(coalesce({c}, m{i}) - m{i}) / s{i} AS z{i}" for i, c in enumerate(cols))
    means = ", ".join([f"avg(z{i}) AS a{i}" for i in range(p)] + [f"avg(z{p}) AS a{p}"])
    return (
        f"mm AS (SELECT {mean} FROM {role}), sc AS (SELECT {keep}, {sd} FROM {role}, mm), "
        f"z AS MATERIALIZED (SELECT dataset, {rows}, {y} AS z{p} FROM {role}, sc), mo AS (SELECT {means}, count(*) AS n FROM z)"
    )


def matrix(entry, p: int, q: int) -> str:
    """A list of lists whose (i, j) is the SQL expression ``entry(i, j)``."""
    return "[" + ", ".join("[" + ", ".join(entry(i, j) for j in range(q)) + "]" for i in range(p)) + "]"


def vector(entry, p: int) -> str:
    return "[" + ", ".join(entry(i) for i in range(p)) + "]"


def descent(sweeps: int, name: str = "cd", st: str = "st", pr: str = "pr") -> str:
    """CTE ``cd`` from ``pr`` (id, alpha, l1, g DOUBLE[][], c DOUBLE[], f DOUBLE[]): coefficients b after so many sweeps.

    Minimises b'gb/2 - c'b + alpha (l1 f|b| + (1 - l1) f b^2 / 2).
    """
    return f"""{st} AS (
  SELECT id, 0 AS t, [0.0::DOUBLE FOR e IN c] AS b FROM {pr}
  UNION ALL
  SELECT id, t + 1, list_concat(list_concat(b[1:k - 1], [sign(r) * greatest(abs(r) - alpha * l1 * f[k], 0) / (g[k][k] + alpha * (1 - l1) * f[k])]), b[k + 1:])
  FROM (SELECT s.id, t, b, k, alpha, l1, f, g, c[k] - list_inner_product(g[k], b) + g[k][k] * b[k] AS r
    FROM (SELECT id, t, b, t % len(b) + 1 AS k FROM {st}) s JOIN {pr} p ON p.id = s.id WHERE t < {sweeps} * len(b))
), {name} AS (SELECT id, b FROM {st} WHERE t = {sweeps} * len(b))"""


def logistic(rows: str, p: int, name: str, newtons: int = 10, sweeps: int = 25) -> str:
    """CTE ``{name}`` (id, b, a) from ``{name}_pr`` (id, alpha, l1): penalised logistic regression on ``rows``.

    ``rows`` has x1.., y and o (offset). A period of steps is one sum over the rows (the working response of Newton's
    method) and ``sweeps`` rounds of coordinate descent on it.
    """
    period = 1 + sweeps * p
    xs = [f"x{i + 1}" for i in range(p)]
    x = "[" + ", ".join(xs) + "]"
    eta = f"m[{p + 1}] - list_inner_product(b, m[1:{p}]) + list_inner_product(b, {x}) + o"
    g = matrix(lambda i, j: f"sum(w * {xs[i]} * {xs[j]}) / count(*) - sum(w * {xs[i]}) * sum(w * {xs[j]}) / sum(w) / count(*)", p, p)
    c = vector(lambda i: f"sum(w * {xs[i]} * z) / count(*) - sum(w * {xs[i]}) * sum(w * z) / sum(w) / count(*)", p)
    m = "[" + ", ".join([*(f"sum(w * {v}) / sum(w)" for v in xs), "sum(w * z) / sum(w)"]) + "]"
    zeros = lambda k: "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"
    flat = "[" + ", ".join([zeros(p)] * p) + "]"
    return f"""{name}_st AS (
  SELECT id, 0 AS t, {zeros(p)} AS b, {flat} AS g, {zeros(p)} AS c, {zeros(p + 1)} AS m FROM {name}_pr
  UNION ALL (
    SELECT id, any_value(t) + 1, any_value(b), {g}, {c}, {m}
    FROM (SELECT *, e - o + (y - u) / w AS z FROM (SELECT *, greatest(u * (1 - u), 1e-10) AS w FROM (SELECT *, 1 / (1 + exp(-e)) AS u FROM
      (SELECT id, t, b, {", ".join(xs)}, y, o, {eta} AS e FROM {name}_st, {rows} WHERE t % {period} = 0 AND t < {newtons * period}))))
    GROUP BY id
    UNION ALL
    SELECT id, t + 1, list_concat(list_concat(b[1:k - 1], [sign(r) * greatest(abs(r) - alpha * l1, 0) / (g[k][k] + alpha * (1 - l1))]), b[k + 1:]), g, c, m
    FROM (SELECT s.id, t, b, g, c, m, k, alpha, l1, c[k] - list_inner_product(g[k], b) + g[k][k] * b[k] AS r
      FROM (SELECT *, (t % {period} - 1) % {p} + 1 AS k FROM {name}_st) s JOIN {name}_pr pr ON pr.id = s.id WHERE t % {period} <> 0 AND t < {newtons * period})
  )
), {name} AS (SELECT id, b, m[{p + 1}] - list_inner_product(b, m[1:{p}]) AS a FROM {name}_st WHERE t = {newtons * period})"""
