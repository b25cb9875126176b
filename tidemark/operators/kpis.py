"""Outcome counts and KPI means by store, date, hour and level.

All KPI means run over ongoing minutes: an order that was ongoing for twenty
minutes has twenty votes. Outcome counts are distinct orders, keyed without
the store name, so a store with two names repeats its counts on both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.functions.aggregates import means_of_sums, minute_weighted_means, minute_weighted_sums
from tidemark.functions.joins import null_safe_join, to_long
from tidemark.operators.concurrency import concurrency_curve, hour_segments, hourly_concurrency
from tidemark.operators.grid import Grid


def outcome_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct delivered and cancelled orders per ``keys``.

    Duplicates collapse under a hash that includes the order id, so the first
    shuffle is even; only partial counts meet at the group.
    """
    per_order = rows.groupBy(*keys, S.ORDER).agg(*[F.max(c).alias(c) for c in S.OUTCOMES])
    counted = [f"coalesce(sum({c}) FILTER (WHERE {S.ORDER} IS NOT NULL), 0) AS {c}" for c in S.OUTCOMES]
    return per_order.groupBy(*keys).agg(*map(F.expr, counted))


def kpi_means(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The seven KPI means per ``keys``, weighted by column ``minutes``."""
    return rows.groupBy(*keys).agg(*minute_weighted_means("minutes"))


# --- store -----------------------------------------------------------------


def store_kpis(intervals: DataFrame) -> DataFrame:
    """One row per store: outcomes of its ongoing orders and KPI means."""
    keys = [S.STORE]
    joined = null_safe_join(outcome_counts(intervals, keys), kpi_means(intervals, keys), keys)
    return joined.select(S.STORE, *S.CONCEPTS)


def level_sums(levelled: DataFrame) -> DataFrame:
    """Per store, name and level: what the means at this and any coarser grain are made of."""
    return levelled.groupBy(S.STORE, S.NAME, S.LEVEL).agg(*minute_weighted_sums("minutes"))


def store_kpis_of_levels(sums: DataFrame, outcomes: DataFrame) -> DataFrame:
    """:func:`store_kpis` from :func:`level_sums` and :func:`outcomes_by_level`.

    An order has one level, so distinct orders of a store are the sum over its
    levels, and the sums behind the means add up.
    """
    keys = [S.STORE]
    counted = outcomes.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in S.OUTCOMES])
    joined = null_safe_join(counted, sums.groupBy(*keys).agg(*means_of_sums(added=True)), keys)
    return joined.select(S.STORE, *S.CONCEPTS)


def kpis_by_level_of_sums(sums: DataFrame, outcomes: DataFrame) -> DataFrame:
    """:func:`kpis_by_level` from staged :func:`level_sums` and :func:`outcomes_by_level`."""
    keys = [S.STORE, S.NAME, S.LEVEL]
    means = sums.select(*keys, *means_of_sums())
    joined = null_safe_join(means, outcomes, [S.STORE, S.LEVEL], "left")
    return joined.select(*keys, *S.CONCEPTS)


def store_kpis_long(store_kpis: DataFrame) -> DataFrame:
    return to_long(store_kpis, [S.STORE], S.CONCEPTS, "value")


def store_wtp_totals(store_kpis: DataFrame) -> DataFrame:
    """Delivered orders of a store and their total and mean waiting time at pickup."""
    return store_kpis.selectExpr(
        S.STORE,
        "delivered AS total_orders",
        "delivered * avg_min_wtp AS total_wtp",
        "avg_min_wtp AS avg_wtp",
    )


# --- by hour ---------------------------------------------------------------


def outcomes_by_date_hour(orders: DataFrame) -> DataFrame:
    """Outcome rows of all orders by activation date and hour (not distinct)."""
    return orders.groupBy(S.STORE, "date", "hour").agg(
        *[F.expr(f"coalesce(sum({c}), 0) AS {c}") for c in S.OUTCOMES]
    )


def outcomes_by_hour(orders: DataFrame) -> DataFrame:
    """Distinct outcomes of all orders by activation hour."""
    return outcome_counts(orders, [S.STORE, "hour"])


def _by_hour(
    intervals: DataFrame,
    curve: DataFrame | None,
    keys: list[str],
    outcomes: DataFrame,
    outcome_keys: list[str],
    grid: Grid | None,
) -> DataFrame:
    segments = hour_segments(intervals.drop("hour"), grid)
    hourly = hourly_concurrency(curve or concurrency_curve(intervals), keys, grid)
    hourly = null_safe_join(kpi_means(segments, keys), hourly, keys)
    joined = null_safe_join(hourly, outcomes, outcome_keys, "left")
    return joined.select(*keys, *S.OUTCOMES, "avg_ongoing_orders", *S.KPI_MEANS)


def kpis_by_date_hour(
    orders: DataFrame, intervals: DataFrame, curve: DataFrame | None = None, grid: Grid | None = None
) -> DataFrame:
    """Per store, name, date and clock hour; outcomes go by activation hour."""
    outcomes = outcomes_by_date_hour(orders)
    return _by_hour(intervals, curve, [*S.CELL, "hour"], outcomes, [S.STORE, "date", "hour"], grid)


def kpis_by_hour(
    orders: DataFrame, intervals: DataFrame, curve: DataFrame | None = None, grid: Grid | None = None
) -> DataFrame:
    """Per store, name and clock hour over all dates."""
    return _by_hour(intervals, curve, [S.STORE, S.NAME, "hour"], outcomes_by_hour(orders), [S.STORE, "hour"], grid)


# --- by level --------------------------------------------------------------


def outcomes_by_date_level(levelled: DataFrame) -> DataFrame:
    return outcome_counts(levelled, [S.STORE, "date", S.LEVEL])


def outcomes_by_level(levelled: DataFrame) -> DataFrame:
    return outcome_counts(levelled, [S.STORE, S.LEVEL])


def _by_level(levelled: DataFrame, keys: list[str], outcomes: DataFrame, outcome_keys: list[str]) -> DataFrame:
    joined = null_safe_join(kpi_means(levelled, keys), outcomes, outcome_keys, "left")
    return joined.select(*keys, *S.CONCEPTS)


def kpis_by_date_level(levelled: DataFrame) -> DataFrame:
    """Per store, name, date and level."""
    outcome_keys = [S.STORE, "date", S.LEVEL]
    return _by_level(levelled, [*S.CELL, S.LEVEL], outcomes_by_date_level(levelled), outcome_keys)


def kpis_by_level(levelled: DataFrame) -> DataFrame:
    """The central table: per store, name and level over all dates."""
    return _by_level(levelled, [S.STORE, S.NAME, S.LEVEL], outcomes_by_level(levelled), [S.STORE, S.LEVEL])
