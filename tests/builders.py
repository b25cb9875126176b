"""Small order logs for tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schema as S

LOG_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.TimestampNTZType() if f.name in S.LIFECYCLE else f.dataType)
        for f in S.ORDER_LOG_CSV.fields
    ]
)


def at(text: str | None) -> datetime | None:
    """``06-01 10:00:00[.9]`` in 2020."""
    if text is None:
        return None
    form = "%Y-%m-%d %H:%M:%S.%f" if "." in text else "%Y-%m-%d %H:%M:%S"
    return datetime.strptime(f"2020-{text}", form)


def order(order_id, dispatch, pickup, store=1, name="A", status="DeliveredStatus", **more) -> dict:
    row = {
        S.STORE: store,
        S.NAME: name,
        S.ORDER: order_id,
        "final_status": status,
        "activation_time_local": at(dispatch),
        "partner_dispatch_time_local": at(dispatch),
        "partner_accepted_time_local": at(dispatch),
        "enters_pickup_local": at(dispatch),
        "pickup_time_local": at(pickup),
        "delivery_time_local": at(pickup),
        "cpo": 1.0,
        "cm0": 2.0,
    }
    return row | more


def log_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[f] for f in LOG_SCHEMA.names) for r in rows], LOG_SCHEMA)


def level_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Level table from (name, level, delivered, wtp, dispatch) rows of store 1.

    The accept time is unknown everywhere, the preparation time is 31.
    """
    schema = "store_name string, ongoing_orders int, delivered bigint, avg_min_wtp double, avg_min_dispatch double"
    return spark.createDataFrame(rows, schema).select(
        F.lit(1).cast("bigint").alias(S.STORE),
        S.NAME,
        S.LEVEL,
        "delivered",
        F.lit(0).cast("bigint").alias("cancels"),
        "avg_min_dispatch",
        F.lit(None).cast("double").alias("avg_min_accept"),
        "avg_min_wtp",
        F.lit(31.0).alias("avg_min_prep_time"),
        F.lit(40.0).alias("avg_min_dt"),
        F.lit(1.0).alias("avg_cpo"),
        F.lit(2.0).alias("avg_cm0"),
    )
