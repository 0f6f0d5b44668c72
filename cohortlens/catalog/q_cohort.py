"""Cohort construction queries over the event observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort as c
from ..operators import sequential as s
from ..plans.cohort_extraction import extract_cohort
from .registry import query
from .roles import CONCEPTS, grid, obs, r6, sta, stays, table, wide, with_roles

_COLS = ", ".join(f'round("{x}", 6) AS "{x}"' for x in CONCEPTS)


def _rounded(df, cols=CONCEPTS):
    return df.withColumns({x: r6(x) for x in cols})


@query("c01_concepts_wide", with_roles("wide") + f"SELECT dataset, stay_id, time_h, {_COLS} FROM wide")
def _(spark, sf):
    return _rounded(wide(spark, sf))


@query(
    "c03_change_id",
    "SELECT o_custkey AS patient_id, l_linenumber, l_quantity FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, sf):
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("patient_id"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return c.change_id(lines, ids, "l_orderkey", "patient_id")


@query(
    "c04_to_interval",
    "SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 3600000000) AS BIGINT) AS time_h, "
    "CAST(floor((epoch_us(ts) - epoch_us(t0)) / 21600000000) AS BIGINT) AS time_6h FROM events "
    "JOIN (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = 'view' GROUP BY user_id) USING (user_id)",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    first = events.where("event_type = 'view'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    timed = c.to_interval(events.join(first, "user_id"), "ts", "t0")
    return c.to_interval(timed, "ts", "t0", "time_6h", 6).select("event_id", "time_h", "time_6h")


@query("c05_stay_windows", with_roles("windows") + "SELECT * FROM windows")
def _(spark, sf):
    return c.stay_windows(obs(spark, sf))


@query("c06_stop_obs_at", with_roles("stays") + "SELECT * FROM stays")
def _(spark, sf):
    return stays(spark, sf)


@query("c07_expand_grid", with_roles("hours") + "SELECT * FROM hours")
def _(spark, sf):
    return c.expand_grid(stays(spark, sf))


@query("c08_map_to_grid", with_roles("grid") + f"SELECT dataset, stay_id, time_h, {_COLS} FROM grid")
def _(spark, sf):
    return _rounded(grid(spark, sf))


@query("c09_filter_step", with_roles("obs") + "SELECT * FROM obs WHERE value < 20 OR value > 200")
def _(spark, sf):
    return c.filter_step(obs(spark, sf), lambda v: (v < 20) | (v > 200), "value")


@query(
    "c10_filter_in_windows",
    with_roles("obs")
    + ", win AS (SELECT dataset, stay_id, time_h AS start_h, time_h + 6 AS end_h FROM obs WHERE concept = 'error') "
    "SELECT * FROM obs o WHERE EXISTS (SELECT 1 FROM win w WHERE w.dataset = o.dataset "
    "AND w.stay_id = o.stay_id AND w.start_h <= o.time_h AND o.time_h <= w.end_h)",
)
def _(spark, sf):
    o = obs(spark, sf)
    win = o.where("concept = 'error'").select(
        "dataset", "stay_id", F.col("time_h").alias("start_h"), (F.col("time_h") + 6).alias("end_h")
    )
    return c.filter_in_windows(o, win)


@query(
    "c11_mutate_step",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, coalesce(click, 0.0) > 0 AS click, coalesce(view, 0.0) > 0 AS view FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", "click", "view")
    return c.mutate_step(g, lambda v: F.coalesce(v, F.lit(0.0)) > 0, ["click", "view"])


@query(
    "c11_mutate_step_by",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, round(max(click) OVER w, 6) AS click, round(max(view) OVER w, 6) AS view "
    "FROM grid WINDOW w AS (PARTITION BY dataset, stay_id)",
)
def _(spark, sf):
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", "click", "view")
    return _rounded(c.mutate_step(g, F.max, ["click", "view"], c.STAY), ["click", "view"])


@query(
    "c12_summary_step",
    with_roles("obs")
    + "SELECT dataset, stay_id, round(avg(value), 9) AS mean_value, max(value) AS max_value FROM obs GROUP BY dataset, stay_id",
)
def _(spark, sf):
    return c.summary_step(obs(spark, sf), {"mean_value": r6(F.avg("value"), 9), "max_value": F.max("value")})


@query("c13_summary_exists", with_roles("obs") + 'SELECT DISTINCT dataset, stay_id, true AS "exists" FROM obs')
def _(spark, sf):
    return c.summary_exists(obs(spark, sf))


@query(
    "c14_summary_count",
    with_roles("wide") + "SELECT dataset, stay_id, count(*) AS n FROM wide GROUP BY dataset, stay_id",
)
def _(spark, sf):
    return c.summary_count(wide(spark, sf))


@query(
    "c15_summary_any",
    with_roles("wide")
    + "SELECT dataset, stay_id, bool_or(click > 200) AS big_click, bool_or(error > 200) AS big_error "
    "FROM wide GROUP BY dataset, stay_id",
)
def _(spark, sf):
    flags = wide(spark, sf).select(
        "dataset", "stay_id", (F.col("click") > 200).alias("big_click"), (F.col("error") > 200).alias("big_error")
    )
    return c.summary_any(flags, ["big_click", "big_error"])


def _edge_sql(order: str) -> str:
    return (
        with_roles("obs") + "SELECT dataset, stay_id, time_h, concept, value FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY dataset, stay_id ORDER BY {order}) AS i FROM obs) WHERE i = 1"
    )


@query("c16_summary_first", _edge_sql("time_h, concept, value"))
def _(spark, sf):
    return c.summary_first(obs(spark, sf), order=["time_h", "concept", "value"])


@query("c16_summary_last", _edge_sql("time_h DESC, concept DESC, value DESC"))
def _(spark, sf):
    return c.summary_last(obs(spark, sf), order=["time_h", "concept", "value"])


_N_OBS = " + ".join(f'CAST("{x}" IS NOT NULL AS INTEGER)' for x in CONCEPTS)


@query("c18_n_obs_per_row", with_roles("grid") + f"SELECT dataset, stay_id, time_h, {_N_OBS} AS n FROM grid")
def _(spark, sf):
    return c.n_obs_per_row(grid(spark, sf), CONCEPTS).select("dataset", "stay_id", "time_h", "n")


_RUNS = (
    f", seen AS (SELECT dataset, stay_id, time_h, ({_N_OBS}) > 0 AS v FROM grid), "
    "isl AS (SELECT *, row_number() OVER (PARTITION BY dataset, stay_id ORDER BY time_h) - row_number() OVER "
    "(PARTITION BY dataset, stay_id, v ORDER BY time_h) AS g FROM seen), "
    "runs AS (SELECT dataset, stay_id, v, g, count(*) AS len FROM isl GROUP BY dataset, stay_id, v, g), "
    "longest AS (SELECT dataset, stay_id, CAST(max(CASE WHEN v THEN 0 ELSE len END) AS BIGINT) AS lengths "
    "FROM runs GROUP BY dataset, stay_id) "
)


@query("c19_longest_run", with_roles("grid") + _RUNS + "SELECT * FROM longest")
def _(spark, sf):
    seen = c.n_obs_per_row(grid(spark, sf), CONCEPTS).withColumn("v", F.col("n") > 0)
    return c.longest_run(seen, "v", False)


#: Limits that make every rule hit some stay of the event data.
_RULES = c.Rules(min_stay_hours=690, min_rows=50, max_gap_hours=40)
_EXCL = (
    _RUNS
    + ", e1 AS (SELECT dataset, stay_id FROM stays WHERE end_h < 0), "
    "e2 AS (SELECT dataset, stay_id FROM windows WHERE end_h - start_h < 690), "
    "e3 AS (SELECT dataset, stay_id FROM wide GROUP BY dataset, stay_id HAVING count(*) < 50), "
    "e4 AS (SELECT dataset, stay_id FROM longest WHERE lengths > 40), "
    "excl AS (SELECT 1 AS step, * FROM e1 UNION ALL SELECT 2, * FROM e2 UNION ALL SELECT 3, * FROM e3 "
    "UNION ALL SELECT 4, * FROM e4) "
)


def _excl_lists(spark, sf):
    o = obs(spark, sf)
    windows = c.stay_windows(o).withColumn("los_h", F.col("end_h") - F.col("start_h"))
    cut = c.stop_obs_at(windows)
    return cut, c.exclusions(cut, c.concepts_wide(o, CONCEPTS), CONCEPTS, _RULES)


@query("c20_exclusions", with_roles("grid", "windows") + _EXCL + "SELECT step, dataset, stay_id FROM excl")
def _(spark, sf):
    _, lists = _excl_lists(spark, sf)
    out = None
    for i, ids in enumerate(lists, 1):
        part = ids.select(F.lit(i).alias("step"), "dataset", "stay_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "c21_attrition",
    with_roles("grid", "windows")
    + _EXCL
    + ", first AS (SELECT s.dataset, s.stay_id, min(step) AS f FROM stays s LEFT JOIN excl e "
    "ON e.dataset = s.dataset AND e.stay_id = s.stay_id GROUP BY s.dataset, s.stay_id) "
    "SELECT CAST(k AS INTEGER) AS step, (SELECT count(*) FROM first WHERE f IS NULL OR f > k) AS incl_n, "
    "(SELECT count(*) FROM excl WHERE step = k) AS excl_n_total, "
    "(SELECT count(*) FROM first WHERE f = k) AS excl_n FROM (SELECT range AS k FROM range(1, 5))",
)
def _(spark, sf):
    cut, lists = _excl_lists(spark, sf)
    return c.exclude(cut, lists)[1]


@query(
    "c21_exclude",
    with_roles("grid", "windows")
    + _EXCL
    + "SELECT dataset, stay_id, start_h, end_h FROM stays s WHERE NOT EXISTS "
    "(SELECT 1 FROM excl e WHERE e.dataset = s.dataset AND e.stay_id = s.stay_id)",
)
def _(spark, sf):
    cut, lists = _excl_lists(spark, sf)
    return c.exclude(cut, lists)[0].select("dataset", "stay_id", "start_h", "end_h")


_DYN = "SELECT dataset, stay_id FROM obs WHERE concept = 'purchase' AND value > 150"


def _presence(spark, sf):
    o = obs(spark, sf)
    return c.require_dynamic(c.stay_windows(o), o.where("concept = 'purchase' and value > 150"))


@query(
    "c22_require_dynamic",
    with_roles("windows") + f"SELECT * FROM windows w WHERE EXISTS (SELECT 1 FROM ({_DYN}) d "
    "WHERE d.dataset = w.dataset AND d.stay_id = w.stay_id)",
)
def _(spark, sf):
    return _presence(spark, sf)[0]


@query(
    "c22_removed",
    with_roles("windows") + f"SELECT count(*) AS removed FROM windows w WHERE NOT EXISTS (SELECT 1 FROM ({_DYN}) d "
    "WHERE d.dataset = w.dataset AND d.stay_id = w.stay_id)",
)
def _(spark, sf):
    return _presence(spark, sf)[1]


@query(
    "c23_static_for",
    with_roles("windows") + "SELECT dataset, stay_id AS id, ward, hospital_id, age FROM sta "
    "WHERE stay_id IN (SELECT stay_id FROM windows)",
)
def _(spark, sf):
    return c.static_for(c.stay_windows(obs(spark, sf)), sta(spark, sf), {"stay_id": "id"})


def _frame_sql(a: str, b: str) -> str:
    return f"(PARTITION BY dataset, stay_id ORDER BY time_h ROWS BETWEEN {a} AND {b})"


@query(
    "c24_pad_rollsum",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, "
    f"round(coalesce(sum(click) OVER {_frame_sql('CURRENT ROW', '4 FOLLOWING')}, 0), 6) AS s_left, "
    f"round(coalesce(sum(click) OVER {_frame_sql('4 PRECEDING', 'CURRENT ROW')}, 0), 6) AS s_right, "
    f"round(coalesce(sum(click) OVER {_frame_sql('2 PRECEDING', '2 FOLLOWING')}, 0), 6) AS s_center, "
    f"CASE WHEN count(click) OVER {_frame_sql('1 PRECEDING', 'CURRENT ROW')} = 2 THEN "
    f"round(sum(click) OVER {_frame_sql('1 PRECEDING', 'CURRENT ROW')}, 6) END AS s_strict FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", "click")
    for align in ("left", "right", "center"):
        g = s.pad_rollsum(g, "click", 5, align, f"s_{align}")
    g = s.pad_rollsum(g, "click", 2, "right", "s_strict", na_rm=False)
    return _rounded(g, ["s_left", "s_right", "s_center", "s_strict"]).drop("click")


@query(
    "c25_pad_rollind",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, "
    f"coalesce(sum(error) OVER {_frame_sql('5 PRECEDING', 'CURRENT ROW')}, 0) > 0 AS recent FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", "error")
    return s.pad_rollind(g, "error", 6, "right", "recent").drop("error")


@query(
    "c26_outcome_window",
    with_roles("grid")
    + ", ev AS (SELECT dataset, stay_id, time_h, CASE WHEN purchase > 100 THEN 1 ELSE 0 END AS e FROM grid), "
    f"p1 AS (SELECT *, max(e) OVER {_frame_sql('CURRENT ROW', '6 FOLLOWING')} AS f FROM ev) "
    f"SELECT dataset, stay_id, time_h, max(f) OVER {_frame_sql('3 PRECEDING', 'CURRENT ROW')} > 0 AS outcome FROM p1",
)
def _(spark, sf):
    event = F.coalesce(F.col("purchase") > 100, F.lit(False))
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", event.alias("outcome"))
    return s.outcome_window(g, "outcome", 6, 3)


@query(
    "c27_set_window",
    with_roles("grid")
    + "SELECT dataset, stay_id, time_h, CASE WHEN time_h >= 6 AND time_h < 24 THEN -1.0 ELSE round(view, 6) END AS view FROM grid",
)
def _(spark, sf):
    g = grid(spark, sf).select("dataset", "stay_id", "time_h", "view")
    return _rounded(s.set_window(g, "view", 6, 24, -1.0), ["view"])


@query(
    "c28_has_gaps",
    with_roles("wide")
    + "SELECT dataset, stay_id, bool_or(d <> 1) AS has_gaps FROM (SELECT dataset, stay_id, "
    "coalesce(time_h - lag(time_h) OVER (PARTITION BY dataset, stay_id ORDER BY time_h), 1) AS d FROM wide) "
    "GROUP BY dataset, stay_id",
)
def _(spark, sf):
    return s.gaps(wide(spark, sf).select("dataset", "stay_id", "time_h"))


@query(
    "flagship_cohort",
    with_roles("grid", "windows")
    + _RUNS
    + ", kept AS (SELECT s.* FROM stays s JOIN longest USING (dataset, stay_id) JOIN windows w USING (dataset, stay_id) "
    "WHERE lengths <= 48 AND w.end_h >= 4 AND (SELECT count(*) FROM wide x WHERE x.dataset = s.dataset "
    "AND x.stay_id = s.stay_id) >= 4), "
    "filled AS (SELECT g.dataset, g.time_h, last_value(purchase IGNORE NULLS) OVER "
    "(PARTITION BY g.dataset, g.stay_id ORDER BY g.time_h) AS v FROM grid g JOIN kept USING (dataset, stay_id)) "
    "SELECT dataset, time_h // 24 AS day, count(*) AS stay_hours, count(v) AS covered, round(avg(v), 9) AS mean_last "
    "FROM filled GROUP BY dataset, time_h // 24",
)
def flagship(spark, sf):
    """Events to an excluded, gridded, filled panel and a summary by dataset and day."""
    from ..operators.features import ffill

    cohort = extract_cohort(obs(spark, sf), sta(spark, sf), CONCEPTS)
    filled = ffill(cohort.dyn.select("dataset", "stay_id", "time_h", "purchase"), ["purchase"])
    day = F.floor(F.col("time_h") / 24).alias("day")
    return filled.groupBy("dataset", day).agg(
        F.count("*").alias("stay_hours"),
        F.count("purchase_ffilled").alias("covered"),
        r6(F.avg("purchase_ffilled"), 9).alias("mean_last"),
    )
