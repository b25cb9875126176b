"""Order log derived from a plain ``orders`` table.

Gives every order a deterministic lifecycle computed from its keys: store
sizes grow linearly, some stores carry a second name, waits rise during a
lunch rush by store class, and each nullable column has NULLs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.order_log import LOG_COLUMNS


def _at(seconds: str, unless: str = "false") -> str:
    """The day's timestamp at a second of day, NULL under a condition."""
    return f"CASE WHEN NOT ({unless}) THEN timestampadd(SECOND, {seconds}, day) END"


def order_log_from_orders(orders: DataFrame) -> DataFrame:
    first_day = orders.agg(F.min("o_orderdate").cast("timestamp_ntz")).scalar()
    keyed = orders.select(
        F.expr("o_orderkey AS k"),
        F.expr("o_orderstatus AS st"),
        F.expr("o_totalprice AS tp"),
        F.expr("CAST(floor(sqrt(CAST(o_custkey AS DOUBLE))) AS BIGINT) AS store"),
        F.expr("""CASE WHEN o_orderkey % 2 = 0 THEN 43200 + (o_orderkey * 7919) % 10800
                  ELSE 21600 + (o_orderkey * 7919) % 64800 END AS activated"""),
        (first_day + F.expr("make_dt_interval(CAST(o_orderkey % 5 AS INT))")).alias("day"),
    )
    rush = """CASE WHEN store % 4 = 0 OR activated < 43200 OR activated >= 54000 THEN 0
              WHEN store % 4 = 1 THEN 600 + (k * 17) % 900
              WHEN store % 4 = 2 THEN 100 + (k * 17) % 900
              ELSE (k * 17) % 900 END"""
    timed = keyed.selectExpr(
        "*",
        "activated + 30 + (k * 13) % 240 AS sent",
        "sent + 15 + (k * 29) % 400 AS accepted",
        "accepted + 120 + (k * 37) % 900 AS arrived",
        f"arrived + (k * 31) % 600 + {rush} AS picked",
        "picked + 300 + (k * 41) % 1500 AS handed",
        "st = 'P' AND k % 3 = 0 AS canceled",
        "concat('STORE_', CAST(store AS STRING)) AS name",
    )
    return timed.selectExpr(
        "k AS order_id",
        "store AS store_address_id",
        "CASE WHEN k % 97 = 0 THEN concat(name, '_B') ELSE name END AS store_name",
        "CASE WHEN canceled THEN 'CanceledStatus' ELSE 'DeliveredStatus' END AS final_status",
        f"{_at('activated')} AS activation_time_local",
        f"{_at('sent')} AS partner_dispatch_time_local",
        f"{_at('accepted', 'k % 23 = 0')} AS partner_accepted_time_local",
        f"{_at('arrived', 'k % 11 = 0')} AS enters_pickup_local",
        f"{_at('picked', 'canceled AND k % 6 = 0')} AS pickup_time_local",
        f"{_at('handed', 'canceled')} AS delivery_time_local",
        "CASE WHEN k % 19 <> 0 THEN CAST(200 + k % 300 AS DOUBLE) / 100 END AS cpo",
        "tp / 100000 - 1 AS cm0",
    ).select(*LOG_COLUMNS)
