"""Aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S


def _sources() -> list[tuple[str, int, str]]:
    """Column, its unit and the name of its mean, for each KPI."""
    times = [(d.micros, S.MICROS_PER_MINUTE, f"avg_{d.name}") for d in S.DURATIONS]
    return times + [(c, 1, f"avg_{c}") for c in S.COSTS]


def minute_weighted_sums(weight: str) -> list[Column]:
    """Of each KPI the weighted sum and the weight of the rows where it is known."""
    sums = []
    for source, _, _ in _sources():
        sums.append(F.expr(f"sum(CAST({source} AS DOUBLE) * {weight}) AS total_{source}"))
        sums.append(F.expr(f"CAST(sum({weight}) FILTER (WHERE {source} IS NOT NULL) AS DOUBLE) AS known_{source}"))
    return sums


def means_of_sums(added: bool = False) -> list[Column]:
    """The means behind :func:`minute_weighted_sums`, of one row or, ``added``, of a group of them."""
    part = "sum({})" if added else "{}"
    return [
        F.expr(f"{part.format(f'total_{c}')} / ({part.format(f'known_{c}')} * {float(unit)!r}D) AS {name}")
        for c, unit, name in _sources()
    ]


def minute_weighted_means(weight: str) -> list[Column]:
    """Means of the seven KPIs, one vote per minute the order was ongoing.

    ``sum(w*x) / sum(w where x is known)`` over orders equals the plain mean
    over one row per order and minute, without producing those rows. Durations
    are summed as whole microseconds held in doubles: exact up to 2**53 and
    never overflowing beyond, so equal means compare equal whatever the order
    of summation. A KPI without any value is NULL.
    """

    def mean(source: str, unit: int, name: str) -> Column:
        known = f"CAST(sum({weight}) FILTER (WHERE {source} IS NOT NULL) AS DOUBLE)"
        total = f"sum(CAST({source} AS DOUBLE) * {weight})"
        return F.expr(f"{total} / ({known} * {float(unit)!r}D) AS {name}")

    return [mean(*source) for source in _sources()]


def r_squared(y: str, x: str) -> str:
    """SQL for R² of the least-squares line y ~ x over rows where both are known.

    No complete pair: NULL. Constant x: the line explains nothing, 0. Constant
    y: undefined, NULL.
    """
    return f"""CASE WHEN regr_count({y}, {x}) = 0 THEN NULL
                    WHEN regr_sxx({y}, {x}) = 0 THEN 0.0D
                    WHEN regr_syy({y}, {x}) = 0 THEN NULL
                    ELSE regr_r2({y}, {x}) END"""
