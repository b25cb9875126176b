"""Saturation thresholds, the orders above them, and what to do about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.joins import null_safe_join

GROUP = [S.STORE, S.NAME]

# threshold column suffix -> the KPI it is derived from
THRESHOLD_KPIS = {
    "dispatch": "avg_min_dispatch",
    "accept": "avg_min_accept",
    "wtp": "avg_min_wtp",
    "prep_time": "avg_min_prep_time",
}


def level_thresholds(by_level: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Level table with the four thresholds of each (store, name).

    *dispatch*, *accept*: the level at which the KPI peaks, the highest on
    ties; minus infinity as soon as the KPI is unknown at any level, which puts
    every level above it. *wtp*, *prep_time*: the second-lowest level at which
    the KPI reaches its limit; NULL when there is no second one, except that a
    (store, name) with a single level may use that level.

    Two rounds of window aggregates over one partitioning: the first finds
    peaks and lowest exceedances, the second the levels they point at.
    """
    over = f"OVER (PARTITION BY {', '.join(GROUP)})"
    peaks = ["dispatch", "accept"]
    limits = {"wtp": cfg.wtp_limit, "prep_time": cfg.prep_limit}

    first = [f"count(*) {over} AS n_levels"]
    second = []
    for suffix in peaks:
        kpi = THRESHOLD_KPIS[suffix]
        first += [f"max({kpi}) {over} AS peak_{suffix}", f"count({kpi}) {over} AS known_{suffix}"]
        second.append(
            f"""CASE WHEN known_{suffix} < n_levels THEN double('-Infinity')
                     ELSE max(CASE WHEN {kpi} = peak_{suffix} THEN double({S.LEVEL}) END) {over}
                END AS threshold_{suffix}"""
        )
    for suffix, limit in limits.items():
        exceeds = f"{THRESHOLD_KPIS[suffix]} >= {float(limit)!r}D"
        first.append(f"min(CASE WHEN {exceeds} THEN {S.LEVEL} END) {over} AS low_{suffix}")
        second.append(
            f"""double(CASE WHEN n_levels = 1 THEN low_{suffix}
                  ELSE min(CASE WHEN {exceeds} AND {S.LEVEL} > low_{suffix} THEN {S.LEVEL} END) {over}
                END) AS threshold_{suffix}"""
        )
    return by_level.selectExpr("*", *first).selectExpr(*by_level.columns, *second)


def impact(thresholds: DataFrame, suffix: str) -> DataFrame:
    """Delivered orders and their waiting time on levels above one threshold.

    Groups without a level above the threshold have no row.
    """
    threshold = f"threshold_{suffix}"
    return (
        thresholds.where(f"{S.LEVEL} > {threshold}")
        .groupBy(*GROUP, threshold)
        .agg(
            F.expr(f"coalesce(sum(delivered), 0) AS lost_orders_{suffix}"),
            F.expr(f"coalesce(sum(delivered * avg_min_wtp), 0.0D) AS wtp_impact_{suffix}"),
        )
    )


def impacts(thresholds: DataFrame) -> DataFrame:
    """All four impacts per (store, name) and KPI, NULL where nothing lies above.

    One conditional aggregation unfolded into four rows; no joins.
    """
    aggregates, rows = [], []
    for suffix, kpi in THRESHOLD_KPIS.items():
        above = f"FILTER (WHERE {S.LEVEL} > threshold_{suffix})"
        aggregates += [
            f"max(threshold_{suffix}) {above} AS threshold_{suffix}",
            f"sum(delivered) {above} AS lost_{suffix}",
            f"sum(delivered * avg_min_wtp) {above} AS wtp_{suffix}",
        ]
        hit = f"threshold_{suffix} IS NOT NULL"
        rows.append(
            f"""struct('{kpi}' AS concept, threshold_{suffix} AS threshold,
                       CASE WHEN {hit} THEN coalesce(lost_{suffix}, 0) END AS lost_orders,
                       CASE WHEN {hit} THEN coalesce(wtp_{suffix}, 0.0D) END AS wtp_impact)"""
        )
    wide = thresholds.groupBy(*GROUP).agg(*map(F.expr, aggregates))
    return wide.selectExpr(*GROUP, f"inline(array({', '.join(rows)}))")


def assess(impacts: DataFrame, totals: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Impacts with the share of orders lost, the waiting time left, a suggestion.

    ``impact_wtp`` is the mean waiting time without the lost orders, capped at
    the real one. With nothing left it is the real one, or NULL if no waiting
    time remained to be spread.
    """
    rated = (
        null_safe_join(impacts, totals, [S.STORE], "left")
        .selectExpr(
            "*",
            "try_divide(lost_orders, total_orders) AS perc_lost",
            """CASE WHEN total_orders <> lost_orders
                    THEN try_divide(total_wtp - wtp_impact, total_orders - lost_orders)
                    WHEN total_wtp - wtp_impact > 0 THEN avg_wtp END AS remaining_wtp""",
        )
        .selectExpr(
            "*",
            "CASE WHEN remaining_wtp > avg_wtp THEN avg_wtp ELSE remaining_wtp END AS impact_wtp",
            f"""CASE WHEN perc_lost >= {float(cfg.critical_share)!r}D THEN 'Critical'
                     WHEN perc_lost >= {float(cfg.follow_up_share)!r}D THEN 'Follow-up'
                     WHEN perc_lost >= 0 THEN 'Decrease'
                     WHEN threshold IS NULL AND avg_wtp <= {float(cfg.increase_wtp)!r}D THEN 'Increase'
                     ELSE 'Keep' END AS suggestion""",
        )
    )
    zeroed = ["threshold", "lost_orders", "perc_lost", "impact_wtp"]
    return rated.withColumns({c: F.expr(f"CASE WHEN suggestion = 'Keep' THEN 0.0D ELSE {c} END") for c in zeroed})


def store_suggestions(impacts: DataFrame, totals: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The suggestion report, decided on waiting time at pickup."""
    waiting = impacts.where("concept = 'avg_min_wtp'")
    return assess(waiting, totals, cfg).selectExpr(
        S.STORE,
        S.NAME,
        "suggestion",
        "threshold AS suggested_threshold",
        "lost_orders AS potential_lost_orders",
        "perc_lost",
        "impact_wtp",
        "avg_wtp AS real_wtp",
    )
