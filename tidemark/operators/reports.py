"""Wide report tables and the long tables behind the charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.columns import level_range, level_range_labels
from tidemark.functions.joins import null_safe_join, to_long

GROUP = [S.STORE, S.NAME]


def _beside_store(long: DataFrame, kpis_long: DataFrame, r2_long: DataFrame | None, how: str) -> DataFrame:
    """Adds the store-wide ``value`` of each concept and, if given, its ``r2``."""
    out = null_safe_join(long, kpis_long, [S.STORE, "concept"], how)
    return out if r2_long is None else null_safe_join(out, r2_long, [S.STORE, "concept"], how)


def _widen(long: DataFrame, header: str, values: Sequence) -> DataFrame:
    """Cells of ``header`` become columns behind the remaining, row-identifying ones.

    ``values`` are all that occur, so no job looks them up and no number of them is
    too many. Store-wide columns are joined before this, as nothing cheap can be
    done with thousands of level columns afterwards.
    """
    lead = [c for c in (*GROUP, "concept", "r2", "value") if c in long.columns]
    if not values:
        return long.select(*lead).distinct()
    return long.groupBy(*lead).pivot(header, list(values)).agg(F.first("cell"))


def report_hour(by_hour: DataFrame, kpis_long: DataFrame, cfg: StudyConfig) -> DataFrame:
    """InfoHour: every KPI by clock hour, beside its store-wide value.

    The mean number of ongoing orders has no store-wide value and drops out.
    """
    long = to_long(by_hour, [*GROUP, "hour"], S.CONCEPTS, "cell")
    return _widen(_beside_store(long, kpis_long, None, "inner"), "hour", cfg.hours)


def report_level_long(by_level: DataFrame, kpis_long: DataFrame, r2_long: DataFrame) -> DataFrame:
    """The level report before its levels become columns."""
    long = to_long(by_level, [*GROUP, S.LEVEL], S.CONCEPTS, "cell")
    return _beside_store(long, kpis_long, r2_long, "inner").select(
        *GROUP, "concept", "r2", "value", S.LEVEL, "cell"
    )


def levels_of(by_level: DataFrame) -> list[int]:
    """The levels that occur: the header of InfoOO, at most as many as orders were ongoing at once."""
    return [r[0] for r in by_level.select(S.LEVEL).distinct().orderBy(S.LEVEL).collect()]


def report_level(
    by_level: DataFrame, kpis_long: DataFrame, r2_long: DataFrame, levels: Sequence[int]
) -> DataFrame:
    """InfoOO: every KPI by level, with a column for each of ``levels``, see :func:`levels_of`."""
    return _widen(report_level_long(by_level, kpis_long, r2_long), S.LEVEL, levels)


def unfolded(report: DataFrame, header: str = S.LEVEL) -> DataFrame:
    """A wide level report with a row per cell, those of levels that a store never reached included.

    The header is whatever columns stand behind the row-identifying ones; ``header``
    gets their names as numbers. A report without level columns has no cells.
    """
    lead = [c for c in (*GROUP, "concept", "r2", "value") if c in report.columns]
    cells = [c for c in report.columns if c not in lead]
    if not cells:
        return report.selectExpr(*lead, f"CAST(NULL AS INT) AS {header}", "CAST(NULL AS DOUBLE) AS cell").limit(0)
    long = report.unpivot(lead, cells, header, "cell")
    return long.withColumn(header, F.col(header).cast("int"))


def kpis_by_level_range(by_level: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Levels rolled up to ranges; each level has one vote in the means.

    The four partner-side times are unknown for a range as soon as they are
    unknown for one of its levels; delivery time and costs skip such levels.
    """
    strict = S.TIME_MEANS[:4]

    def mean(c: str) -> str:
        return f"CASE WHEN count({c}) = count(*) THEN avg({c}) END AS {c}" if c in strict else f"avg({c}) AS {c}"

    ranged = by_level.withColumn("level_range", F.expr(level_range(S.LEVEL, cfg)))
    measures = [f"sum({c}) AS {c}" for c in S.OUTCOMES] + [mean(c) for c in S.KPI_MEANS]
    return ranged.groupBy(*GROUP, "level_range").agg(*map(F.expr, measures))


def cumulative_by_range(ranges: DataFrame) -> DataFrame:
    """Adds delivered orders up to and including each range, and their share."""
    group = f"PARTITION BY {', '.join(GROUP)}"
    accum = f"sum(delivered) OVER ({group} ORDER BY level_range ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    total = f"sum(delivered) OVER ({group})"
    return ranges.selectExpr("*", f"{accum} AS accum", f"try_divide({accum}, {total}) AS perc")


def report_level_range(
    by_level: DataFrame, kpis_long: DataFrame, r2_long: DataFrame, cfg: StudyConfig
) -> DataFrame:
    """InfoGroup: every KPI by level range, with running delivered totals."""
    outcomes = S.OUTCOMES if cfg.include_cancels else ["delivered"]
    concepts = [*outcomes, "accum", "perc", *S.KPI_MEANS]
    cumulative = cumulative_by_range(kpis_by_level_range(by_level, cfg))
    long = to_long(cumulative, [*GROUP, "level_range"], concepts, "cell")
    return _widen(_beside_store(long, kpis_long, r2_long, "left"), "level_range", level_range_labels(cfg))


def _series(by_level: DataFrame, top: DataFrame, carried: list[str], concepts: list[str]) -> DataFrame:
    kept = null_safe_join(by_level, top.select(S.STORE), [S.STORE], "left_semi")
    return to_long(kept, [*GROUP, S.LEVEL, *carried], concepts, "value", label="kpi")


def series_times(by_level: DataFrame, top: DataFrame) -> DataFrame:
    """Chart input: the five times by level for the busiest stores."""
    return _series(by_level, top, S.COST_MEANS, S.TIME_MEANS)


def series_orders(by_level: DataFrame, top: DataFrame) -> DataFrame:
    """Chart input: outcomes by level for the busiest stores."""
    return _series(by_level, top, [], S.OUTCOMES)


def series_costs(by_level: DataFrame, top: DataFrame) -> DataFrame:
    """Chart input: costs by level for the busiest stores."""
    return _series(by_level, top, [], S.COST_MEANS)


def scatter_input(by_level: DataFrame) -> DataFrame:
    """Scatter-matrix input: the level and the four partner-side times."""
    return by_level.select(S.LEVEL, *S.TIME_MEANS[:4])


#: Odd factors below 2**32 and the modulus of the hash that orders a sample.
HASH_FACTORS, HASH_MODULUS = (2_654_435_761, 2_246_822_519, 3_266_489_917), 1 << 32


def sample_key(store: str, level: str) -> str:
    """SQL for a hash of store and level below 2**32, which any engine with 64-bit numbers computes alike."""
    by_store, by_level, mixed = HASH_FACTORS
    low = 1 << 31  # each product stays within 64 bits
    folded = f"pmod(coalesce({store}, -1), {low}L) * {by_store}L % {HASH_MODULUS}L"
    joined = f"({folded} + pmod(coalesce({level}, -1), {low}L) * {by_level}L % {HASH_MODULUS}L)"
    return f"({joined} % {low}L) * {mixed}L % {HASH_MODULUS}L"


def scatter_sample(by_level: DataFrame, n: int) -> DataFrame:
    """At most ``n`` rows of :func:`scatter_input`, the same ones in every run, with the keys they were drawn by.

    The rows with the smallest hashes of store and level, so that a row is kept or
    not whatever else is in the table; ties go by store, name and level. Each task
    keeps its own ``n`` smallest, and only these meet.
    """
    if n < 1:
        raise ValueError("a sample has at least one row")
    drawn = by_level.select(
        F.expr(sample_key(S.STORE, S.LEVEL)).alias("sample_key"), *GROUP, S.LEVEL, *S.TIME_MEANS[:4]
    )
    return drawn.orderBy("sample_key", *GROUP, S.LEVEL).limit(n)
