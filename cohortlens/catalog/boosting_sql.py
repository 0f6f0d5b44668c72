"""SQL twins of boosting: one recursive step for each level of a tree, one for each tree of a refit."""

from __future__ import annotations

from collections.abc import Sequence


def boosting(
    source: str,
    train: str,
    features: Sequence[str],
    rounds: int,
    rate: float,
    depth: int = 3,
    gamma: float = 1.0,
    group: str = "dataset",
    weight: str = "1.0",
    least: int = 20,
) -> str:
    """CTEs over the rows of ``source``, of which those where ``train`` holds are learnt from.

    ``b0`` numbers the rows (rid); ``x0`` has one row for each feature of a row; ``st`` the state after every level:
    after the last level of tree k (step k * depth) the score, the row's leaf and its value. Children of node i are
    2 i and 2 i + 1. Thresholds are the values that occur; missing values go to the side that gains more.
    """
    values = " UNION ALL ".join(f"SELECT rid, {i} AS f, CAST({c} AS DOUBLE) AS v FROM b0" for i, c in enumerate(features))
    return f"""b0 AS MATERIALIZED (SELECT row_number() OVER () AS rid, *, ({train}) AS learn, CAST({weight} AS DOUBLE) AS wt FROM {source}),
x0 AS MATERIALIZED ({values}),
st AS (
  SELECT 0 AS step, rid, CAST(1 AS BIGINT) AS node, (SELECT avg(y) FROM b0 WHERE learn) AS score, CAST(NULL AS BIGINT) AS leaf, CAST(NULL AS DOUBLE) AS value FROM b0
  UNION ALL (
    WITH q0 AS MATERIALIZED (SELECT step, rid, node, score, y - score AS r, learn, wt, {group} AS grp FROM st JOIN b0 USING (rid) WHERE step < {rounds * depth}),
    q AS MATERIALIZED (SELECT step, rid, node, score, learn, wt, r + {gamma - 1.0} * sum(wt * r) FILTER (learn) OVER w / sum(wt) FILTER (learn) OVER w AS r FROM q0 WINDOW w AS (PARTITION BY grp)),
    h AS MATERIALIZED (SELECT node, f, v, sum(wt * r) AS g, sum(wt) AS h, count(*) AS n FROM q JOIN x0 USING (rid) WHERE learn GROUP BY node, f, v),
    c AS (SELECT node, f, v, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n FROM h WHERE v IS NOT NULL WINDOW w AS (PARTITION BY node, f ORDER BY v)),
    t AS (SELECT node, f, sum(g) AS tg, sum(h) AS th, sum(n) AS tn, coalesce(sum(g) FILTER (v IS NULL), 0) AS mg,
      coalesce(sum(h) FILTER (v IS NULL), 0) AS mh, coalesce(sum(n) FILTER (v IS NULL), 0) AS mn FROM h GROUP BY node, f),
    o AS (SELECT node, f, v, ml, g + ml * mg AS gl, h + ml * mh AS hl, n + ml * mn AS nl, tg, th, tn
      FROM c JOIN t USING (node, f), (SELECT unnest([1, 0]) AS ml) WHERE ml = 1 OR mn > 0),
    e AS (SELECT *, gl * gl / hl + (tg - gl) * (tg - gl) / (th - hl) - tg * tg / th AS gain FROM o WHERE nl >= {least} AND tn - nl >= {least}),
    p AS MATERIALIZED (SELECT node, f, v, ml FROM e WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, v, ml DESC) = 1),
    m AS MATERIALIZED (SELECT q.*, CASE WHEN p.node IS NULL THEN q.node WHEN coalesce(x0.v <= p.v, p.ml = 1) THEN 2 * q.node ELSE 2 * q.node + 1 END AS child
      FROM q LEFT JOIN p USING (node) LEFT JOIN x0 ON x0.rid = q.rid AND x0.f = p.f),
    l AS (SELECT *, {rate} * sum(wt * r) FILTER (learn) OVER w / sum(wt) FILTER (learn) OVER w AS moved FROM m WINDOW w AS (PARTITION BY child))
    SELECT step + 1, rid, CASE WHEN (step + 1) % {depth} = 0 THEN 1 ELSE child END, CASE WHEN (step + 1) % {depth} = 0 THEN score + moved ELSE score END,
      CASE WHEN (step + 1) % {depth} = 0 THEN child END, CASE WHEN (step + 1) % {depth} = 0 THEN moved END FROM l
  )
)"""


def refit(rounds: int, new: str, rate: float, decays: Sequence[float], depth: int = 3) -> str:
    """CTE ``rf`` (tree, decay, rid, score): scores whose leaf values have moved towards the rows where ``new`` holds."""
    return f"""rf AS (
  SELECT 0 AS tree, decay, rid, score FROM st, (SELECT unnest({list(decays)}::DOUBLE[]) AS decay) WHERE step = 0
  UNION ALL (
    WITH q AS (SELECT tree, decay, rf.rid, rf.score, st.leaf, st.value, CASE WHEN {new} THEN y - rf.score END AS r
      FROM rf JOIN st ON st.rid = rf.rid AND st.step = (tree + 1) * {depth} JOIN b0 ON b0.rid = rf.rid WHERE tree < {rounds})
    SELECT tree + 1, decay, rid, score + decay * value + (1 - decay) * {rate} * coalesce(avg(r) OVER (PARTITION BY decay, leaf), 0) FROM q
  )
)"""
