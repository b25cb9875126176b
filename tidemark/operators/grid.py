"""The times of day at which an order can be ongoing, and their places in a row.

Everything downstream counts places: an order is ongoing from one place up to
another, concurrency is a step function over places, and areas and minute counts
are sums over places. On the regular grid the place of a time is its minute of
the day. On a supplied one it is its number among the grid's working times, which
may be any seconds of the day, with gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import StudyConfig

DAY_SECONDS = 86_400


class MinuteGrid:
    """Every whole minute within the working hours."""

    def __init__(self, cfg: StudyConfig):
        self._open, self._close = cfg.open_minute, cfg.close_minute

    def span(self, begin: str, end: str) -> tuple[Column, Column]:
        """First place of ``begin <= time < end``, given as seconds of the day, and the place behind the last."""
        return (
            F.expr(f"greatest({self._open}, CAST(ceil({begin} / 60) AS INT))"),
            F.expr(f"least({self._close}, CAST(ceil({end} / 60) AS INT))"),
        )

    def hour_of(self, place: str) -> Column:
        return F.expr(f"CAST(({place}) DIV 60 AS INT)")

    def hour_begin(self, hour: str) -> Column:
        """The place at which an hour begins."""
        return F.expr(f"({hour}) * 60")

    def on_clock(self, rows: DataFrame) -> DataFrame:
        """Rows with their place in ``minute`` as readers know it."""
        return rows


class SuppliedGrid:
    """The working times of a grid table, see :func:`grid_places`.

    Both arrays enter the plans as constants of one day at most, so a place is
    looked up where the order is read, without a join or a search.
    """

    def __init__(self, places: DataFrame):
        self._times = places.select("times").scalar()
        self._ranks = places.select("ranks").scalar()

    def span(self, begin: str, end: str) -> tuple[Column, Column]:
        return F.get(self._ranks, F.expr(begin)), F.get(self._ranks, F.expr(end))

    def hour_of(self, place: str) -> Column:
        return (F.get(self._times, F.expr(place)) / 3600).cast("int")

    def hour_begin(self, hour: str) -> Column:
        return F.get(self._ranks, F.expr(f"({hour}) * 3600"))

    def on_clock(self, rows: DataFrame) -> DataFrame:
        """``second`` of the day instead of the place."""
        kept = [F.col(c) if c != "minute" else F.get(self._times, "minute").alias("second") for c in rows.columns]
        return rows.select(*kept)


Grid = MinuteGrid | SuppliedGrid


def grid_places(grid: DataFrame, cfg: StudyConfig) -> DataFrame:
    """One row: the sorted working ``times`` of a grid, and for each second of the day its ``ranks``.

    The rank of a second is the number of times before it, which is the place of
    the first time that is not. ``grid`` has a ``second`` of the day per row; repeated
    and missing ones and those outside the working hours do not count. The one
    window and the two lists hold the seconds of a day, however long the log.
    """
    begin, end = cfg.open_hour * 3600, cfg.close_hour * 3600
    times = grid.where(f"second >= {begin} AND second < {end}").select(F.col("second").cast("int")).distinct()
    day = grid.sparkSession.range(0, DAY_SECONDS + 1, 1, 1).selectExpr("CAST(id AS INT) AS second")
    marked = day.join(F.broadcast(times.withColumn("hit", F.lit(1))), "second", "left")
    before = "sum(hit) OVER (ORDER BY second ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = marked.selectExpr("second", "hit", f"CAST(coalesce({before}, 0) AS INT) AS rank")
    return ranked.agg(
        F.expr("array_sort(collect_list(IF(hit = 1, second, NULL)))").alias("times"),
        F.expr("transform(array_sort(collect_list(struct(second, rank))), x -> x.rank)").alias("ranks"),
    )
