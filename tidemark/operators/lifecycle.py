"""From log rows to typed orders with outcomes, durations and clock times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.columns import local_timestamp, second_of_day


def parse_lifecycle(log: DataFrame) -> DataFrame:
    """The six lifecycle columns as TIMESTAMP_NTZ; unparseable text is NULL."""
    parsed = {}
    for field in log.schema.fields:
        if field.name not in S.LIFECYCLE or isinstance(field.dataType, T.TimestampNTZType):
            continue
        is_text = isinstance(field.dataType, T.StringType)
        parsed[field.name] = F.expr(
            local_timestamp(field.name) if is_text else f"CAST({field.name} AS TIMESTAMP_NTZ)"
        )
    return log.withColumns(parsed) if parsed else log


def status_flags(log: DataFrame, cfg: StudyConfig) -> DataFrame:
    """``delivered`` and ``cancels``: 1, or NULL for any other outcome."""
    return log.withColumns(
        {
            "delivered": F.when(F.col("final_status") == cfg.delivered_status, 1),
            "cancels": F.when(F.col("final_status") == cfg.canceled_status, 1),
        }
    )


def clock_times(log: DataFrame) -> DataFrame:
    """Second of day at which the order reached the store and was picked up."""
    return log.withColumns(
        {
            "dispatch_tod": F.expr(second_of_day("partner_dispatch_time_local")),
            "pickup_tod": F.expr(second_of_day("pickup_time_local")),
        }
    )


def duration_micros(log: DataFrame) -> DataFrame:
    """The five durations in whole microseconds, possibly negative."""
    return log.withColumns(
        {d.micros: F.expr(f"timestampdiff(MICROSECOND, {d.start}, {d.end})") for d in S.DURATIONS}
    )


def duration_minutes(orders: DataFrame) -> DataFrame:
    """The five durations in fractional minutes."""
    unit = f"{float(S.MICROS_PER_MINUTE)!r}D"
    return orders.withColumns({d.name: F.expr(f"{d.micros} / {unit}") for d in S.DURATIONS})


def order_facts(log: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The narrow order table every later step reads."""
    typed = duration_micros(clock_times(status_flags(parse_lifecycle(log), cfg)))
    return typed.selectExpr(
        S.ORDER,
        S.STORE,
        S.NAME,
        "to_date(activation_time_local) AS date",
        "hour(activation_time_local) AS hour",
        "dispatch_tod",
        "pickup_tod",
        *S.OUTCOMES,
        *[d.micros for d in S.DURATIONS],
        *S.COSTS,
    )
