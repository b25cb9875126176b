"""Independent SQL for every registered query, run by DuckDB in the checks.

Written after the definitions, not after the Spark code: concurrency by a
range join on the minute grid and window counts, impacts by one filtered
aggregate per threshold joined back, pivots by conditional aggregates.
"""

from __future__ import annotations

import re

KPIS = ["min_dispatch", "min_accept", "min_wtp", "min_prep_time", "min_dt", "cpo", "cm0"]
MEANS = [f"avg_{k}" for k in KPIS]
COSTS = MEANS[5:]
# added before rounding to 6 decimals: means of a few decimals often end in the middle of two of them
OFF_TIES = "1.234567e-8"
CONCEPTS = ["delivered", "cancels", *MEANS]
THRESHOLDS = {"dispatch": "avg_min_dispatch", "accept": "avg_min_accept", "wtp": "avg_min_wtp", "prep_time": "avg_min_prep_time"}
RANGES = ["01--05", "05--10", "10--15", "15--20", "20--25", "25--30", "30--35", "35--40", "40--45", "45--50", "50+"]
# whole-number columns that hold NULLs, published as doubles
NULLABLE_COUNTS = {
    "status_flags": ["delivered", "cancels"],
    "time_of_day": ["dispatch_tod", "pickup_tod"],
    "kpis_by_date_hour": ["delivered", "cancels"],
    "kpis_by_hour": ["delivered", "cancels"],
    "reconcile_by_store": ["delivered", "cancels"],
    "impacts": ["lost_orders"],
    "lost_orders_long": ["lost_orders"],
    "kpis_by_hour_grid": ["delivered", "cancels"],
}
TIMESTAMPS = [
    "activation_time_local",
    "partner_dispatch_time_local",
    "partner_accepted_time_local",
    "enters_pickup_local",
    "pickup_time_local",
    "delivery_time_local",
]

ORDER_LOG = {
    "anchor": "SELECT min(o_orderdate) AS d0 FROM orders",
    "base": """
  SELECT o_orderkey AS k, o_orderstatus AS st, o_totalprice AS tp, d0,
         CAST(floor(sqrt(CAST(o_custkey AS DOUBLE))) AS BIGINT) AS store,
         CASE WHEN o_orderkey % 2 = 0 THEN 43200 + (o_orderkey * 7919) % 10800
              ELSE 21600 + (o_orderkey * 7919) % 64800 END AS act_s
  FROM orders CROSS JOIN anchor""",
    "s": """
  SELECT k, st, tp, d0, store, act_s,
         act_s + 30 + (k * 13) % 240 AS t1,
         act_s + 30 + (k * 13) % 240 + 15 + (k * 29) % 400 AS t2,
         act_s + 30 + (k * 13) % 240 + 15 + (k * 29) % 400 + 120 + (k * 37) % 900 AS t3,
         (k * 31) % 600 + CASE WHEN store % 4 = 0 THEN 0 WHEN NOT (act_s >= 43200 AND act_s < 54000) THEN 0
           WHEN store % 4 = 1 THEN 600 + (k * 17) % 900 WHEN store % 4 = 2 THEN 100 + (k * 17) % 900
           ELSE (k * 17) % 900 END AS w
  FROM base""",
    "log": """
  SELECT k AS order_id, store AS store_address_id,
       CASE WHEN k % 97 = 0 THEN concat('STORE_', CAST(store AS VARCHAR(20)), '_B')
            ELSE concat('STORE_', CAST(store AS VARCHAR(20))) END AS store_name,
       CASE WHEN st = 'P' AND k % 3 = 0 THEN 'CanceledStatus' ELSE 'DeliveredStatus' END AS final_status,
       d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * act_s AS activation_time_local,
       d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * t1 AS partner_dispatch_time_local,
       CASE WHEN k % 23 = 0 THEN NULL ELSE d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * t2 END AS partner_accepted_time_local,
       CASE WHEN k % 11 = 0 THEN NULL ELSE d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * t3 END AS enters_pickup_local,
       CASE WHEN st = 'P' AND k % 6 = 0 THEN NULL ELSE d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * (t3 + w) END AS pickup_time_local,
       CASE WHEN st = 'P' AND k % 3 = 0 THEN NULL ELSE d0 + INTERVAL '1' DAY * (k % 5) + INTERVAL '1' SECOND * (t3 + w + 300 + (k * 41) % 1500) END AS delivery_time_local,
       CASE WHEN k % 19 = 0 THEN NULL ELSE CAST(200 + k % 300 AS DOUBLE) / 100 END AS cpo,
       tp / 100000 - 1 AS cm0
  FROM s""",
}

KPI_MEANS = ", ".join(
    [f"CAST(sum(us_{k[4:]}) AS DOUBLE) / (count(us_{k[4:]}) * 60000000.0) AS avg_{k}" for k in KPIS[:5]]
    + [f"avg({k}) AS avg_{k}" for k in KPIS[5:]]
)
OUTCOMES = """CAST(count(DISTINCT CASE WHEN delivered = 1 THEN order_id END) AS BIGINT) AS delivered,
    CAST(count(DISTINCT CASE WHEN cancels = 1 THEN order_id END) AS BIGINT) AS cancels"""


def _long(table: str, ids: str, concepts: list[str], value: str, label: str = "concept") -> str:
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS {label}, CAST({c} AS DOUBLE) AS {value} FROM {table}" for c in concepts
    )


def _r2(y: str, alias: str) -> str:
    y, x = f"CAST({y} AS DOUBLE)", "CAST(ongoing_orders AS DOUBLE)"
    return f"""CASE WHEN regr_count({y}, {x}) = 0 THEN NULL WHEN regr_sxx({y}, {x}) = 0 THEN 0.0
      WHEN regr_syy({y}, {x}) = 0 THEN NULL ELSE regr_r2({y}, {x}) END AS {alias}"""


def _threshold_ctes() -> dict[str, str]:
    out = {}
    for suffix in THRESHOLDS:
        out[f"imp_{suffix}"] = f"""
  SELECT store_address_id, store_name, threshold_{suffix},
         CAST(coalesce(sum(delivered), 0) AS BIGINT) AS lost_orders_{suffix},
         coalesce(sum(delivered * avg_min_wtp), 0.0) AS wtp_impact_{suffix}
  FROM with_threshold WHERE ongoing_orders > threshold_{suffix}
  GROUP BY store_address_id, store_name, threshold_{suffix}"""
    return out


def _ctes(percentile: float, store_name: str | None = None) -> dict[str, str]:
    by = "store_address_id, store_name"
    brand = f" AND store_name = '{store_name}'" if store_name else ""
    joined_impacts = " ".join(
        f"LEFT JOIN imp_{s} ON imp_{s}.store_address_id = g.store_address_id AND imp_{s}.store_name IS NOT DISTINCT FROM g.store_name"
        for s in THRESHOLDS
    )
    return {
        **ORDER_LOG,
        "counts": "SELECT store_address_id, count(DISTINCT order_id) AS orders FROM log GROUP BY store_address_id",
        "top": f"""SELECT store_address_id, orders FROM counts
    WHERE orders >= (SELECT quantile_cont(orders, {percentile}) FROM counts)""",
        "delivered_counts": """SELECT store_address_id, count(DISTINCT order_id) AS orders FROM log
    WHERE final_status = 'DeliveredStatus' GROUP BY store_address_id""",
        "facts": """
  SELECT *, CAST(activation_time_local AS DATE) AS date, CAST(extract(hour FROM activation_time_local) AS INTEGER) AS act_hour,
    CAST(extract(hour FROM partner_dispatch_time_local) * 3600 + extract(minute FROM partner_dispatch_time_local) * 60
      + floor(extract(second FROM partner_dispatch_time_local)) AS INTEGER) AS dispatch_tod,
    CAST(extract(hour FROM pickup_time_local) * 3600 + extract(minute FROM pickup_time_local) * 60
      + floor(extract(second FROM pickup_time_local)) AS INTEGER) AS pickup_tod,
    CASE WHEN final_status = 'DeliveredStatus' THEN 1 END AS delivered,
    CASE WHEN final_status = 'CanceledStatus' THEN 1 END AS cancels,
    date_diff('microsecond', activation_time_local, partner_dispatch_time_local) AS us_dispatch,
    date_diff('microsecond', partner_dispatch_time_local, partner_accepted_time_local) AS us_accept,
    date_diff('microsecond', enters_pickup_local, pickup_time_local) AS us_wtp,
    date_diff('microsecond', partner_accepted_time_local, pickup_time_local) AS us_prep_time,
    date_diff('microsecond', activation_time_local, delivery_time_local) AS us_dt
  FROM log""",
        "selected": f"SELECT * FROM facts WHERE store_address_id IN (SELECT store_address_id FROM top){brand}",
        "day_grid": "SELECT CAST(range AS INTEGER) AS minute FROM range(0, 1440)",
        "grid": "SELECT minute FROM day_grid WHERE minute >= 420 AND minute < 1260",
        "minute_rows": """
  SELECT selected.*, grid.minute, CAST(floor(grid.minute / 60) AS INTEGER) AS hour
  FROM selected JOIN grid ON dispatch_tod <= grid.minute * 60 AND pickup_tod > grid.minute * 60""",
        "conc": """
  SELECT *, count(*) OVER (PARTITION BY store_address_id, store_name, date, minute) AS ongoing FROM minute_rows""",
        "lvl": """
  SELECT *, CAST(round_even(avg(ongoing) OVER (PARTITION BY order_id), 0) AS INTEGER) AS ongoing_orders FROM conc""",
        "store_kpi": f"SELECT store_address_id, {OUTCOMES}, {KPI_MEANS} FROM minute_rows GROUP BY store_address_id",
        "store_kpi_long": _long("store_kpi", "store_address_id", CONCEPTS, "value"),
        "store_total": """SELECT store_address_id, delivered AS total_orders, delivered * avg_min_wtp AS total_wtp,
    avg_min_wtp AS avg_wtp FROM store_kpi""",
        "outcome_date_hour": """SELECT store_address_id, date, act_hour AS hour, CAST(coalesce(sum(delivered), 0) AS BIGINT) AS delivered,
    CAST(coalesce(sum(cancels), 0) AS BIGINT) AS cancels FROM selected GROUP BY store_address_id, date, act_hour""",
        "outcome_date_level": f"""SELECT store_address_id, date, ongoing_orders, {OUTCOMES} FROM lvl
    GROUP BY store_address_id, date, ongoing_orders""",
        "outcome_hour": f"SELECT store_address_id, act_hour AS hour, {OUTCOMES} FROM selected GROUP BY store_address_id, act_hour",
        "outcome_level": f"SELECT store_address_id, ongoing_orders, {OUTCOMES} FROM lvl GROUP BY store_address_id, ongoing_orders",
        "kpi_date_hour": f"""
  SELECT a.*, d.delivered, d.cancels FROM (
    SELECT {by}, date, hour, avg(ongoing) AS avg_ongoing_orders, {KPI_MEANS} FROM conc GROUP BY {by}, date, hour) a
  LEFT JOIN outcome_date_hour d ON d.store_address_id = a.store_address_id AND d.date = a.date AND d.hour = a.hour""",
        "kpi_date_level": f"""
  SELECT a.*, d.delivered, d.cancels FROM (
    SELECT {by}, date, ongoing_orders, {KPI_MEANS} FROM lvl GROUP BY {by}, date, ongoing_orders) a
  LEFT JOIN outcome_date_level d ON d.store_address_id = a.store_address_id AND d.date = a.date
    AND d.ongoing_orders = a.ongoing_orders""",
        "conc_hour": f"SELECT *, avg(ongoing) OVER (PARTITION BY {by}, date, hour) AS hour_mean FROM conc",
        "kpi_hour": f"""
  SELECT a.*, d.delivered, d.cancels FROM (
    SELECT {by}, hour, avg(hour_mean) AS avg_ongoing_orders, {KPI_MEANS} FROM conc_hour GROUP BY {by}, hour) a
  LEFT JOIN outcome_hour d ON d.store_address_id = a.store_address_id AND d.hour = a.hour""",
        "kpi_level": f"""
  SELECT a.*, d.delivered, d.cancels FROM (
    SELECT {by}, ongoing_orders, {KPI_MEANS} FROM lvl GROUP BY {by}, ongoing_orders) a
  LEFT JOIN outcome_level d ON d.store_address_id = a.store_address_id AND d.ongoing_orders = a.ongoing_orders""",
        "r2": f"SELECT store_address_id, {', '.join(_r2(c, c) for c in CONCEPTS)} FROM kpi_level GROUP BY store_address_id",
        "r2_rows": _long("r2", "store_address_id", CONCEPTS, "r2"),
        "marks": f"""
  SELECT *, max(avg_min_dispatch) OVER g AS top_dispatch, max(avg_min_accept) OVER g AS top_accept,
    bool_or(avg_min_dispatch IS NULL) OVER g AS gap_dispatch, bool_or(avg_min_accept IS NULL) OVER g AS gap_accept,
    count(*) OVER g AS n_levels
  FROM kpi_level WINDOW g AS (PARTITION BY {by})""",
        "marklists": f"""
  SELECT {by}, any_value(n_levels) AS n_levels, bool_or(gap_dispatch) AS gap_dispatch, bool_or(gap_accept) AS gap_accept,
    max(CASE WHEN avg_min_dispatch = top_dispatch THEN ongoing_orders END) AS peak_dispatch,
    max(CASE WHEN avg_min_accept = top_accept THEN ongoing_orders END) AS peak_accept,
    list_sort(list(ongoing_orders) FILTER (WHERE avg_min_wtp >= 15)) AS over_wtp,
    list_sort(list(ongoing_orders) FILTER (WHERE avg_min_prep_time >= 30)) AS over_prep
  FROM marks GROUP BY {by}""",
        "with_threshold": f"""
  SELECT t.store_address_id, t.store_name, t.ongoing_orders, {', '.join('t.' + c for c in CONCEPTS)},
    CASE WHEN gap_dispatch THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(peak_dispatch AS DOUBLE) END AS threshold_dispatch,
    CASE WHEN gap_accept THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(peak_accept AS DOUBLE) END AS threshold_accept,
    CAST(CASE WHEN n_levels = 1 THEN over_wtp[1] ELSE over_wtp[2] END AS DOUBLE) AS threshold_wtp,
    CAST(CASE WHEN n_levels = 1 THEN over_prep[1] ELSE over_prep[2] END AS DOUBLE) AS threshold_prep_time
  FROM kpi_level t JOIN marklists m ON m.store_address_id = t.store_address_id
    AND m.store_name IS NOT DISTINCT FROM t.store_name""",
        **_threshold_ctes(),
        "gathered": f"""
  SELECT DISTINCT g.store_address_id, g.store_name,
    {', '.join(f'threshold_{s}, lost_orders_{s}, wtp_impact_{s}' for s in THRESHOLDS)}
  FROM (SELECT {by} FROM with_threshold) g {joined_impacts}""",
        "impacts": " UNION ALL ".join(
            f"""SELECT {by}, '{c}' AS concept, threshold_{s} AS threshold, lost_orders_{s} AS lost_orders,
      wtp_impact_{s} AS wtp_impact FROM gathered"""
            for s, c in THRESHOLDS.items()
        ),
        "rated": """
  SELECT i.*, t.avg_wtp, lost_orders / CAST(nullif(total_orders, 0) AS DOUBLE) AS lost_share,
    CASE WHEN total_orders <> lost_orders THEN (total_wtp - wtp_impact) / (total_orders - lost_orders)
         WHEN total_wtp - wtp_impact > 0 THEN avg_wtp END AS left_wtp
  FROM impacts i LEFT JOIN store_total t ON t.store_address_id = i.store_address_id""",
        "labelled": """
  SELECT *, CASE WHEN left_wtp > avg_wtp THEN avg_wtp ELSE left_wtp END AS capped,
    CASE WHEN lost_share >= 0.10 THEN 'Critical' WHEN lost_share >= 0.05 THEN 'Follow-up'
         WHEN lost_share >= 0 THEN 'Decrease' WHEN threshold IS NULL AND avg_wtp <= 7.5 THEN 'Increase'
         ELSE 'Keep' END AS suggestion
  FROM rated""",
        "suggested": """
  SELECT store_address_id, store_name, suggestion,
    CASE WHEN suggestion = 'Keep' THEN 0.0 ELSE threshold END AS suggested_threshold,
    CASE WHEN suggestion = 'Keep' THEN 0.0 ELSE CAST(lost_orders AS DOUBLE) END AS potential_lost_orders,
    CASE WHEN suggestion = 'Keep' THEN 0.0 ELSE lost_share END AS perc_lost,
    CASE WHEN suggestion = 'Keep' THEN 0.0 ELSE capped END AS impact_wtp, avg_wtp AS real_wtp
  FROM labelled WHERE concept = 'avg_min_wtp'""",
        "ranged": f"""
  SELECT *, CASE {' '.join(f"WHEN ongoing_orders > {5 * i} AND ongoing_orders <= {5 * i + 5} THEN '{r}'" for i, r in enumerate(RANGES[:10]))}
    WHEN ongoing_orders > 50 THEN '50+' END AS level_range FROM kpi_level""",
        "rollup_range": f"""
  SELECT {by}, level_range, CAST(sum(delivered) AS BIGINT) AS delivered, CAST(sum(cancels) AS BIGINT) AS cancels,
    {', '.join(f"CASE WHEN bool_or({m} IS NULL) THEN NULL ELSE avg({m}) END AS {m}" for m in MEANS[:4])},
    {', '.join(f"avg({m}) AS {m}" for m in MEANS[4:])}
  FROM ranged GROUP BY {by}, level_range""",
        "cumul": f"""
  SELECT *, CAST(sum(delivered) OVER (PARTITION BY {by} ORDER BY level_range) AS BIGINT) AS accum,
    sum(delivered) OVER (PARTITION BY {by} ORDER BY level_range)
      / CAST(nullif(sum(delivered) OVER (PARTITION BY {by}), 0) AS DOUBLE) AS perc
  FROM rollup_range""",
        "busiest": "SELECT store_address_id, orders FROM top ORDER BY orders DESC, store_address_id LIMIT 30",
        "charted": "SELECT * FROM kpi_level WHERE store_address_id IN (SELECT store_address_id FROM busiest)",
    }


def _needed(ctes: dict[str, str], text: str) -> list[str]:
    """CTEs reachable from ``text``, in definition order."""
    wanted: set[str] = set()
    frontier = [text]
    while frontier:
        words = set(re.findall(r"[a-z_0-9]+", frontier.pop()))
        for name in words & ctes.keys() - wanted:
            wanted.add(name)
            frontier.append(ctes[name])
    return [n for n in ctes if n in wanted]


#: A grid of seconds: every third minute with a gap, and two times between minutes.
UNEVEN_GRID = {
    "grid": """SELECT minute * 60 AS second FROM day_grid
    WHERE minute >= 420 AND minute < 1260 AND minute % 3 = 0 AND minute NOT BETWEEN 765 AND 794
  UNION ALL SELECT 47130 UNION ALL SELECT 47250""",
    "minute_rows": """
  SELECT selected.*, second AS minute, CAST(second // 3600 AS INTEGER) AS hour
  FROM selected JOIN grid ON dispatch_tod <= second AND pickup_tod > second""",
}


def _sql(
    scope: tuple[float, str | None],
    final: str,
    cut: list[str] = (),
    absolute: list[str] = (),
    dated: bool = False,
    changed: dict[str, str] | None = None,
) -> str:
    """Full statement; ``cut`` columns rounded to 6 decimals, ``absolute`` to 7, dates as text."""
    ctes = _ctes(*scope) | (changed or {})
    names = _needed(ctes, final)
    changes = [f'round("{c}" + {OFF_TIES}, 6) + 0.0 AS "{c}"' for c in cut]
    changes += [f'round(CAST("{c}" AS DOUBLE), 7) + 0.0 AS "{c}"' for c in absolute]
    changes += ['CAST("date" AS VARCHAR) AS "date"'] * dated
    body = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({final}) AS result" if changes else final
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in names) + "\n" + body


def _pivoted(long: str, header: str, values: list, extra: str, joins: str) -> str:
    """Conditional-aggregate pivot of (store, name, concept, header, value)."""
    cells = ", ".join(f"""max(CASE WHEN {header} = {repr(v)} THEN value END) AS "{v}\"""" for v in values)
    headers = ", ".join(f'"{v}"' for v in values)
    return f"""SELECT w.store_address_id, w.store_name, w.concept, {extra}, {headers} FROM (
    SELECT store_address_id, store_name, concept, {cells} FROM ({long}) l
    GROUP BY store_address_id, store_name, concept) w {joins}"""


def _published(statements: dict[str, str]) -> dict[str, str]:
    """Statements with the columns of ``NULLABLE_COUNTS`` as doubles."""
    out = dict(statements)
    for name in NULLABLE_COUNTS.keys() & out.keys():
        changes = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NULLABLE_COUNTS[name])
        out[name] = f"SELECT * REPLACE ({changes}) FROM ({out[name]}) AS published"
    return out


def selection_sql(percentile: float) -> dict[str, str]:
    """Queries on the log and the store selection."""
    p = (percentile, None)
    tod = "dispatch_tod, pickup_tod"
    minutes = [f"{k}" for k in KPIS[:5]]
    durations = ", ".join(f"us_{k[4:]} / 60000000.0 AS {k}" for k in minutes)
    return _published({
        "order_log_scan": _sql(p, f"SELECT store_address_id, store_name, order_id, final_status, {', '.join(TIMESTAMPS)}, cpo, cm0 FROM log"),
        "order_log_csv": _sql(p, f"""SELECT store_address_id, CASE order_id % 8 WHEN 0 THEN store_name || ', "east" side'
      WHEN 1 THEN '"' || store_name || '"' WHEN 2 THEN store_name || chr(10) || chr(9) || 'upper floor'
      WHEN 3 THEN store_name || chr(92) || 'n' WHEN 4 THEN NULL ELSE store_name END AS store_name,
    order_id, final_status, {', '.join(TIMESTAMPS)}, cpo, cm0 FROM log"""),
        "conflicting_orders": _sql(p, """SELECT order_id, CAST(2 AS BIGINT) AS log_rows, concat_ws(',',
    CASE WHEN (order_id // 6) % 4 = 0 THEN 'store' END, CASE WHEN (order_id // 6) % 5 = 0 THEN 'name' END,
    CASE WHEN (order_id // 6) % 7 = 0 AND final_status <> 'CanceledStatus' THEN 'status' END,
    CASE WHEN (order_id // 6) % 9 = 0 AND pickup_time_local IS NOT NULL THEN 'times' END) AS reason
  FROM log WHERE order_id % 6 = 0 AND reason <> ''"""),
        "store_order_counts_quarantined": _sql(p, """SELECT store_address_id, count(DISTINCT order_id) AS orders FROM log
  WHERE NOT (order_id % 6 = 0 AND ((order_id // 6) % 4 = 0 OR (order_id // 6) % 5 = 0
    OR ((order_id // 6) % 7 = 0 AND final_status <> 'CanceledStatus')
    OR ((order_id // 6) % 9 = 0 AND pickup_time_local IS NOT NULL)))
  GROUP BY store_address_id"""),
        "parse_lifecycle": _sql(p, f"SELECT order_id, {', '.join(TIMESTAMPS)} FROM log"),
        "time_of_day": _sql(p, f"SELECT order_id, {tod} FROM facts"),
        "status_flags": _sql(p, "SELECT order_id, delivered, cancels FROM facts"),
        "duration_kpis": _sql(p, f"SELECT order_id, {durations} FROM facts"),
        "minute_grid": _sql(p, """SELECT concat(CAST(minute // 60 AS VARCHAR), ':', lpad(CAST(minute % 60 AS VARCHAR), 2, '0'), ':00') AS hourmin,
    minute, count(order_id) AS order_minutes
  FROM day_grid LEFT JOIN facts ON dispatch_tod <= minute * 60 AND pickup_tod > minute * 60 GROUP BY minute"""),
        "working_minutes": _sql(p, """SELECT grid.minute, CAST(grid.minute // 60 AS INTEGER) AS hour, count(order_id) AS order_minutes
  FROM grid LEFT JOIN selected ON dispatch_tod <= grid.minute * 60 AND pickup_tod > grid.minute * 60 GROUP BY grid.minute"""),
        "store_order_counts": _sql(p, "SELECT store_address_id, orders FROM counts"),
        "top_stores_percentile": _sql(p, "SELECT store_address_id, orders FROM top"),
        "top_n_stores": _sql(p, "SELECT store_address_id, orders FROM busiest"),
        "orders_of_top_stores": _sql(p, "SELECT order_id, store_address_id FROM selected"),
        "orders_of_named_store": _sql(p, "SELECT order_id, store_address_id, store_name FROM log WHERE store_name = 'STORE_7'"),
        "store_totals": _sql(p, "SELECT count(*) AS n, CAST(sum(orders) AS BIGINT) AS orders FROM delivered_counts"),
        "store_totals_percentile": _sql(p, f"""SELECT count(*) AS n, CAST(sum(orders) AS BIGINT) AS orders FROM delivered_counts
  WHERE orders >= (SELECT quantile_cont(orders, {percentile}) FROM delivered_counts)"""),
        "store_order_distribution": _sql(p, "SELECT orders, count(DISTINCT store_address_id) AS addresses FROM delivered_counts GROUP BY orders"),
    })


def study_sql(percentile: float, store_name: str | None = None) -> dict[str, str]:
    """Queries downstream of the store selection."""
    p = (percentile, store_name)
    by = "store_address_id, store_name"
    concepts, means = ", ".join(CONCEPTS), ", ".join(MEANS)
    reconciled = {
        "outcomes_by_date_hour": "outcome_date_hour",
        "outcomes_by_date_level": "outcome_date_level",
        "kpis_by_date_hour": "kpi_date_hour",
        "kpis_by_date_level": "kpi_date_level",
        "outcomes_by_hour": "outcome_hour",
        "outcomes_by_level": "outcome_level",
        "kpis_by_hour": "kpi_hour",
        "kpis_by_level": "kpi_level",
    }
    value_join = "JOIN store_kpi_long k ON k.store_address_id = w.store_address_id AND k.concept = w.concept"
    r2_join = "JOIN r2_rows r ON r.store_address_id = w.store_address_id AND r.concept = w.concept"
    hour_long = _long("kpi_hour", f"{by}, hour", CONCEPTS, "value")
    range_concepts = ["delivered", "accum", "perc", *MEANS]
    range_long = _long("cumul", f"{by}, level_range", range_concepts, "value")
    hours = list(range(7, 21))
    rounded_levels = f"""SELECT w.store_address_id, w.store_name, w.concept, round(r.r2, 7) + 0.0 AS r2,
    round(k.value + {OFF_TIES}, 6) + 0.0 AS value, w.ongoing_orders, round(w.cell + {OFF_TIES}, 6) + 0.0 AS cell
  FROM ({_long("kpi_level", f"{by}, ongoing_orders", CONCEPTS, "cell")}) w {value_join} {r2_join}"""
    correlated = ["ongoing_orders", "delivered", "cancels", *MEANS[:4]]
    complete = " AND ".join(f"{c} IS NOT NULL" for c in correlated)

    def correlation(guard: bool) -> str:
        source = "kpi_level" if guard else f"(SELECT * FROM kpi_level WHERE {complete})"
        rows = []
        for a in correlated:
            for b in correlated:
                value = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
                if guard:
                    value = f"CASE WHEN count({a}) = count(*) AND count({b}) = count(*) THEN {value} END"
                if a == b:
                    value = "max(CAST(1.0 AS DOUBLE))"
                rows.append(f"SELECT '{a}' AS var1, '{b}' AS var2, {value} AS corr FROM {source} t")
        return " UNION ALL ".join(rows)

    out = {
        "reconcile_by_store": _sql(p, " UNION ALL ".join(
            f"SELECT '{key}' AS summary, store_address_id, CAST(sum(delivered) AS BIGINT) AS delivered, CAST(sum(cancels) AS BIGINT) AS cancels FROM {cte} GROUP BY store_address_id"
            for key, cte in reconciled.items())),
        "ongoing_minutes": _sql(p, f"SELECT order_id, {by}, date, minute FROM minute_rows", dated=True),
        "ongoing_concurrency": _sql(p, f"SELECT order_id, {by}, date, minute, ongoing AS ongoing_orders FROM conc", dated=True),
        "order_level": _sql(p, """SELECT order_id, count(*) AS minutes_ongoing, avg(ongoing) AS mean_ongoing,
    any_value(ongoing_orders) AS ongoing_orders FROM lvl GROUP BY order_id"""),
        "store_kpis": _sql(p, f"SELECT store_address_id, {concepts} FROM store_kpi", COSTS),
        "store_kpis_long": _sql(p, "SELECT store_address_id, concept, value FROM store_kpi_long", ["value"]),
        "store_wtp_totals": _sql(p, "SELECT * FROM store_total", ["total_wtp", "avg_wtp"]),
        "outcomes_by_date_hour": _sql(p, "SELECT * FROM outcome_date_hour", dated=True),
        "outcomes_by_date_level": _sql(p, "SELECT * FROM outcome_date_level", dated=True),
        "outcomes_by_hour": _sql(p, "SELECT * FROM outcome_hour"),
        "outcomes_by_level": _sql(p, "SELECT * FROM outcome_level"),
        "kpis_by_date_hour": _sql(p, f"SELECT {by}, date, hour, delivered, cancels, avg_ongoing_orders, {means} FROM kpi_date_hour", ["avg_ongoing_orders", *COSTS], dated=True),
        "kpis_by_date_level": _sql(p, f"SELECT {by}, date, ongoing_orders, {concepts} FROM kpi_date_level", COSTS, dated=True),
        "kpis_by_hour": _sql(p, f"SELECT {by}, hour, delivered, cancels, avg_ongoing_orders, {means} FROM kpi_hour", ["avg_ongoing_orders", *COSTS]),
        "kpis_by_level": _sql(p, f"SELECT {by}, ongoing_orders, {concepts} FROM kpi_level", COSTS),
        "kpi_r2": _sql(p, "SELECT * FROM r2", absolute=CONCEPTS),
        "kpi_r2_long": _sql(p, "SELECT * FROM r2_rows", absolute=["r2"]),
        "level_kpi_correlation": _sql(p, correlation(False), absolute=["corr"]),
        "level_kpi_correlation_strict": _sql(p, correlation(True), absolute=["corr"]),
        "threshold_argmax": _sql(p, f"SELECT {by}, ongoing_orders, threshold_dispatch, threshold_accept FROM with_threshold"),
        "threshold_second_exceedance": _sql(p, f"SELECT {by}, ongoing_orders, threshold_wtp, threshold_prep_time FROM with_threshold"),
        "level_thresholds": _sql(p, "SELECT * FROM with_threshold", COSTS),
    }
    for s in THRESHOLDS:
        out[f"impact_{s}"] = _sql(p, f"SELECT * FROM imp_{s}", [f"wtp_impact_{s}"])
    out |= {
        "thresholds_long": _sql(p, f"SELECT {by}, concept, threshold FROM impacts"),
        "lost_orders_long": _sql(p, f"SELECT {by}, concept, lost_orders FROM impacts"),
        "wtp_impact_long": _sql(p, f"SELECT {by}, concept, wtp_impact FROM impacts", ["wtp_impact"]),
        "impacts": _sql(p, "SELECT * FROM impacts", ["wtp_impact"]),
        "store_suggestions": _sql(p, "SELECT * FROM suggested", ["perc_lost", "impact_wtp", "real_wtp"]),
        "report_hour": _sql(p, _pivoted(hour_long, "hour", hours, "k.value AS value", value_join), ["value", *map(str, hours)]),
        "report_level": _sql(p, f"""SELECT w.*, h.ongoing_orders, c.cell
  FROM (SELECT DISTINCT store_address_id, store_name, concept, r2, value FROM ({rounded_levels}) a) w
  JOIN (SELECT DISTINCT ongoing_orders FROM kpi_level) h ON true
  LEFT JOIN ({rounded_levels}) c ON c.store_address_id = w.store_address_id AND c.concept = w.concept
    AND c.store_name IS NOT DISTINCT FROM w.store_name AND c.ongoing_orders = h.ongoing_orders"""),
        "report_level_long": _sql(p, rounded_levels),
        "level_range": _sql(p, f"SELECT {by}, ongoing_orders, level_range FROM ranged"),
        "kpis_by_level_range": _sql(p, f"SELECT {by}, level_range, {concepts} FROM rollup_range", MEANS),
        "cumulative_by_range": _sql(p, f"SELECT {by}, level_range, delivered, accum, perc FROM cumul", ["perc"]),
        "report_level_range": _sql(p, _pivoted(range_long, "level_range", RANGES, "r.r2 AS r2, k.value AS value",
                                               f"LEFT {value_join} LEFT {r2_join}"), ["value", *RANGES], ["r2"]),
        "series_times": _sql(p, _long("charted", f"{by}, ongoing_orders, avg_cpo, avg_cm0", MEANS[:5], "value", "kpi"), ["avg_cpo", "avg_cm0", "value"]),
        "series_orders": _sql(p, _long("charted", f"{by}, ongoing_orders", ["delivered", "cancels"], "value", "kpi")),
        "series_costs": _sql(p, _long("charted", f"{by}, ongoing_orders", MEANS[5:], "value", "kpi"), ["value"]),
        "scatter_input": _sql(p, f"SELECT ongoing_orders, {', '.join(MEANS[:4])} FROM kpi_level"),
        "scatter_sample": _sql(p, f"""SELECT
    ((store_address_id * 2654435761) % 4294967296 + (ongoing_orders * CAST(2246822519 AS BIGINT)) % 4294967296)
      % 2147483648 * 3266489917 % 4294967296 AS sample_key,
    {by}, ongoing_orders, {', '.join(MEANS[:4])} FROM kpi_level
  ORDER BY sample_key, store_address_id, store_name, ongoing_orders LIMIT 25"""),
    }
    reports = {"infohour": "report_hour", "infooo": "report_level", "infogroup": "report_level_range", "impacts": "store_suggestions"}
    out |= {f"written_{name}": out[report] for name, report in reports.items()}
    return _published(out)


def grid_sql(percentile: float) -> dict[str, str]:
    """Queries of a study with a supplied grid."""
    p, by, means = (percentile, None), "store_address_id, store_name", ", ".join(MEANS)
    return _published({
        "ongoing_concurrency_grid": _sql(p, f"SELECT order_id, {by}, date, CAST(minute AS INTEGER) AS second, ongoing AS ongoing_orders FROM conc",
                                         dated=True, changed=UNEVEN_GRID),
        "kpis_by_level_grid": _sql(p, f"SELECT {by}, ongoing_orders, {', '.join(CONCEPTS)} FROM kpi_level", COSTS, changed=UNEVEN_GRID),
        "kpis_by_hour_grid": _sql(p, f"SELECT {by}, hour, delivered, cancels, avg_ongoing_orders, {means} FROM kpi_hour",
                                  ["avg_ongoing_orders", *COSTS], changed=UNEVEN_GRID),
        "store_suggestions_grid": _sql(p, "SELECT * FROM suggested", ["perc_lost", "impact_wtp", "real_wtp"], changed=UNEVEN_GRID),
    })
