"""How many orders a store has in progress, minute by minute.

An order is ongoing at every working minute m with dispatch <= m < pickup,
compared by time of day only: the calendar day is not looked at, so an order
picked up after midnight has no ongoing minutes. Orders count together when
they share store, name, activation date and minute.

Nothing here needs one row per order and minute except the operators that
return exactly those rows. Concurrency is a step function per cell, built from
+1/-1 events that are summed before they are shuffled; sums of it over an
order's minutes are differences of its running area.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.joins import null_safe_join
from tidemark.operators.grid import Grid, MinuteGrid

CELL_MINUTE = [*S.CELL, "minute"]
CELL_HOUR = [*S.CELL, "hour"]


def ongoing_intervals(orders: DataFrame, cfg: StudyConfig, grid: Grid | None = None) -> DataFrame:
    """Orders with at least one ongoing minute: [first_minute, end_minute).

    On a supplied grid, here and below, a minute is one of its times, by its place.
    """
    known = orders.where("dispatch_tod IS NOT NULL AND pickup_tod IS NOT NULL")
    first, end = (grid or MinuteGrid(cfg)).span("dispatch_tod", "pickup_tod")
    return (
        known.select("*", first.alias("first_minute"), end.alias("end_minute"))
        .where("first_minute < end_minute")
        .withColumn("minutes", F.expr("end_minute - first_minute"))
    )


def ongoing_minutes(intervals: DataFrame) -> DataFrame:
    """One row per order and ongoing minute."""
    unfolded = intervals.selectExpr("*", "explode(sequence(first_minute, end_minute - 1)) AS minute")
    return unfolded.drop("first_minute", "end_minute", "minutes")


def ongoing_minutes_on_grid(orders: DataFrame, working_grid: DataFrame) -> DataFrame:
    """Same rows for an arbitrary grid of whole minutes, joined hour by hour.

    Each order meets only the grid minutes of the hours it touches. The grid
    is broadcast: distinct minutes of a day are 1,440 rows at most.
    """
    slots = working_grid.where("minute BETWEEN 0 AND 1439").select("minute").distinct()
    slots = slots.selectExpr("minute", "minute DIV 60 AS slot")
    timed = orders.where("dispatch_tod < pickup_tod").selectExpr(
        "*", "explode(sequence(dispatch_tod DIV 3600, pickup_tod DIV 3600)) AS slot"
    )
    return (
        timed.join(F.broadcast(slots), "slot")
        .where("dispatch_tod <= minute * 60 AND pickup_tod > minute * 60")
        .drop("slot")
    )


def ongoing_per_minute(orders: DataFrame) -> DataFrame:
    """How many orders are ongoing at each minute of the day, for minutes with any.

    Two events an order, summed on the map side to 1,440 minutes at most; only
    those sums meet in the one window.
    """
    timed = orders.where(f"{S.ORDER} IS NOT NULL AND dispatch_tod < pickup_tod").selectExpr(
        "CAST(ceil(dispatch_tod / 60) AS INT) AS begin", "CAST(ceil(pickup_tod / 60) AS INT) AS end"
    )
    events = timed.where("begin < end").selectExpr(
        "inline(array(struct(begin AS minute, 1L AS step), struct(end AS minute, -1L AS step)))"
    )
    steps = events.groupBy("minute").agg(F.sum("step").alias("step"))
    curve = steps.selectExpr(
        "minute", "lead(minute) OVER (ORDER BY minute) AS until", "sum(step) OVER (ORDER BY minute) AS order_minutes"
    )
    return curve.where("order_minutes > 0").selectExpr("explode(sequence(minute, until - 1)) AS minute", "order_minutes")


def hour_segments(spans: DataFrame, grid: Grid | None = None) -> DataFrame:
    """[first_minute, end_minute) spans cut at full hours, with ``hour`` and ``minutes`` of each piece.

    An hour in which the grid has no time gives no piece.
    """
    grid = grid or MinuteGrid(StudyConfig())
    kept = [c for c in spans.columns if c not in ("hour", "minutes", "first_minute", "end_minute")]
    hours = F.sequence(grid.hour_of("first_minute"), grid.hour_of("end_minute - 1"))
    return (
        spans.select(*kept, "first_minute", "end_minute", F.explode(hours).alias("hour"))
        .select(
            *kept,
            "hour",
            F.greatest("first_minute", grid.hour_begin("hour")).alias("first_minute"),
            F.least("end_minute", grid.hour_begin("hour + 1")).alias("end_minute"),
        )
        .withColumn("minutes", F.expr("end_minute - first_minute"))
        .where("minutes > 0")
    )


def _events(intervals: DataFrame, *carried: str) -> DataFrame:
    """+1 where an order starts to be ongoing, -1 at the minute it no longer is."""
    return intervals.selectExpr(
        *S.CELL,
        *carried,
        "inline(array(struct(first_minute AS minute, 1 AS step), struct(end_minute AS minute, -1 AS step)))",
    )


def concurrency_curve(intervals: DataFrame) -> DataFrame:
    """Step function per cell: ``ongoing`` orders during [minute, until).

    ``area`` is the sum of the curve over all minutes before ``minute``. Events
    collapse to at most one row per cell and minute on the map side, so each
    window partition is bounded by the minutes of a day however hot the store.
    """
    steps = _events(intervals).groupBy(*CELL_MINUTE).agg(F.sum("step").alias("step"))
    ordered = f"PARTITION BY {', '.join(S.CELL)} ORDER BY minute"
    so_far = f"({ordered} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    running = steps.selectExpr(
        *CELL_MINUTE,
        f"lead(minute) OVER ({ordered}) AS until",
        f"sum(step) OVER {so_far} AS ongoing",
        f"sum(step * minute) OVER {so_far} AS moment",
    )
    return running.selectExpr(*CELL_MINUTE, "until", "ongoing", "minute * ongoing - moment AS area")


def order_levels(intervals: DataFrame, curve: DataFrame | None = None) -> DataFrame:
    """Level of each order: mean concurrency over its minutes, half to even.

    ``curve`` is the :func:`concurrency_curve` of the intervals where it is staged.

    Rows sharing an order id are one order, and so are rows without an id.
    Each interval needs the curve's area at its two ends only; the lookup is
    keyed by cell and minute, which spreads even a single busy store-day over
    many tasks. Areas are whole numbers summed as doubles: exact up to 2**53
    and safe from overflow when an id is repeated on very many rows.
    """
    marks = (curve or concurrency_curve(intervals)).select(*CELL_MINUTE, "area")
    ends = null_safe_join(_events(intervals, S.ORDER), marks, CELL_MINUTE)
    totals = ends.groupBy(S.ORDER).agg(
        F.expr("sum(-step * CAST(area AS DOUBLE)) AS order_minutes"), F.expr("sum(-step * minute) AS minutes_ongoing")
    )
    levels = totals.selectExpr(S.ORDER, "minutes_ongoing", "order_minutes / minutes_ongoing AS mean_ongoing")
    return levels.withColumn(S.LEVEL, F.expr("CAST(rint(mean_ongoing) AS INT)"))


def with_level(intervals: DataFrame, curve: DataFrame | None = None) -> DataFrame:
    """Intervals with the level of their order, reduced to what summaries read.

    Both join sides are plain shuffles on the order id, so adaptive execution
    can split the partition of an id that is repeated on very many rows.
    """
    levels = order_levels(intervals, curve).select(S.ORDER, S.LEVEL)
    kept = [S.ORDER, *S.CELL, *S.OUTCOMES, *[d.micros for d in S.DURATIONS], *S.COSTS, "minutes"]
    return null_safe_join(intervals.select(*kept), levels, [S.ORDER])


def ongoing_concurrency(
    intervals: DataFrame, curve: DataFrame | None = None, grid: Grid | None = None
) -> DataFrame:
    """One row per order and ongoing minute with the cell's concurrency.

    The curve is packed to one row per cell and hour (the grid's times of an hour) and
    joined to hour pieces of the orders; minutes are unfolded after the join,
    so what is shuffled stays at order size.
    """
    per_minute = (
        (curve or concurrency_curve(intervals))
        .where("ongoing > 0")
        .selectExpr(*S.CELL, "ongoing", "explode(sequence(minute, until - 1)) AS minute")
    )
    grid = grid or MinuteGrid(StudyConfig())
    packed = per_minute.groupBy(*S.CELL, grid.hour_of("minute").alias("hour")).agg(
        F.expr("collect_list(struct(minute, ongoing)) AS curve")
    )
    pieces = hour_segments(intervals, grid).select(S.ORDER, *CELL_HOUR, "first_minute", "end_minute")
    return null_safe_join(pieces, packed, CELL_HOUR).selectExpr(
        S.ORDER,
        *S.CELL,
        f"inline(filter(curve, at -> at.minute >= first_minute AND at.minute < end_minute)) AS (minute, {S.LEVEL})",
    )


def hourly_concurrency(curve: DataFrame, keys: list[str], grid: Grid | None = None) -> DataFrame:
    """Mean concurrency per ``keys`` as an ongoing order sees it.

    A minute with n ongoing orders counts n times, so the mean is the sum of
    squares over the sum of the curve; minutes without orders do not count.
    """
    busy = curve.where("ongoing > 0")
    spans = busy.selectExpr(*S.CELL, "ongoing", "minute AS first_minute", "until AS end_minute")
    pieces = hour_segments(spans, grid)
    mean = "sum(CAST(ongoing AS DOUBLE) * ongoing * minutes) / sum(ongoing * minutes)"
    return pieces.groupBy(*keys).agg(F.expr(f"{mean} AS avg_ongoing_orders"))
