"""How strongly KPIs move with the level."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.aggregates import r_squared
from tidemark.functions.joins import to_long

CORRELATED = [S.LEVEL, *S.OUTCOMES, "avg_min_dispatch", "avg_min_accept", "avg_min_wtp", "avg_min_prep_time"]


def kpi_r2(by_level: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Per store, R² of every KPI against the level, in one aggregation.

    Each (name, level) row is one unweighted point. ``compat_labels`` fits
    ``avg_min_wtp`` under the accept and preparation labels too.
    """
    source = {c: c for c in S.CONCEPTS}
    if cfg.compat_labels:
        source.update(avg_min_accept="avg_min_wtp", avg_min_prep_time="avg_min_wtp")
    fits = [F.expr(f"{r_squared(source[c], S.LEVEL)} AS {c}") for c in S.CONCEPTS]
    return by_level.groupBy(S.STORE).agg(*fits)


def kpi_r2_long(r2: DataFrame) -> DataFrame:
    return to_long(r2, [S.STORE], S.CONCEPTS, "r2")


def _correlation_rows(rows: DataFrame, strict: bool) -> DataFrame:
    """All ordered column pairs as (var1, var2, corr), from one aggregate row.

    A constant column correlates with nothing; ``corr`` itself would fail on it.
    """

    def coefficient(a: str, b: str):
        usable = f"count({a}) = count(*) AND count({b}) = count(*)" if strict else "true"
        spread = f"stddev_pop({a}) * stddev_pop({b})"
        corr = f"try_divide(covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), {spread})"
        return F.expr(f"CASE WHEN {usable} THEN {corr} END AS `{a}|{b}`")

    pairs = [coefficient(a, b) for a, b in combinations(CORRELATED, 2)]
    itself = [F.expr(f"max(1.0D) AS `{a}|{a}`") for a in CORRELATED]
    matrix = rows.agg(*pairs, *itself)
    half = matrix.unpivot([], [f"`{c}`" for c in matrix.columns], "pair", "corr")
    return half.selectExpr(
        "corr",
        """inline(array_distinct(array(
             struct(split_part(pair, '|', 1) AS var1, split_part(pair, '|', 2) AS var2),
             struct(split_part(pair, '|', 2) AS var1, split_part(pair, '|', 1) AS var2))))""",
    ).select("var1", "var2", "corr")


def level_kpi_correlation(by_level: DataFrame) -> DataFrame:
    """Pearson matrix over the rows on which all seven columns are known."""
    return _correlation_rows(by_level.dropna(subset=CORRELATED), strict=False)


def level_kpi_correlation_strict(by_level: DataFrame) -> DataFrame:
    """Pearson matrix in which a column with any NULL correlates with nothing."""
    return _correlation_rows(by_level, strict=True)
