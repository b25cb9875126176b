"""Column vocabulary shared by all operators."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

STORE = "store_address_id"
NAME = "store_name"
ORDER = "order_id"
LEVEL = "ongoing_orders"

LIFECYCLE = [
    "activation_time_local",
    "partner_dispatch_time_local",
    "partner_accepted_time_local",
    "enters_pickup_local",
    "pickup_time_local",
    "delivery_time_local",
]

# The order log as it is delivered in a headered CSV file.
ORDER_LOG_CSV = T.StructType(
    [
        T.StructField(STORE, T.LongType()),
        T.StructField(NAME, T.StringType()),
        T.StructField(ORDER, T.LongType()),
        T.StructField("final_status", T.StringType()),
        *[T.StructField(c, T.StringType()) for c in LIFECYCLE],
        T.StructField("cpo", T.DoubleType()),
        T.StructField("cm0", T.DoubleType()),
    ]
)


class Duration(NamedTuple):
    """A lifecycle duration: its KPI name and the two timestamps it spans."""

    name: str
    start: str
    end: str

    @property
    def micros(self) -> str:
        """Column with the exact length in microseconds."""
        return self.name.replace("min_", "us_", 1)


DURATIONS = [
    Duration("min_dispatch", "activation_time_local", "partner_dispatch_time_local"),
    Duration("min_accept", "partner_dispatch_time_local", "partner_accepted_time_local"),
    Duration("min_wtp", "enters_pickup_local", "pickup_time_local"),
    Duration("min_prep_time", "partner_accepted_time_local", "pickup_time_local"),
    Duration("min_dt", "activation_time_local", "delivery_time_local"),
]
COSTS = ["cpo", "cm0"]

MICROS_PER_MINUTE = 60_000_000

OUTCOMES = ["delivered", "cancels"]
TIME_MEANS = [f"avg_{d.name}" for d in DURATIONS]
COST_MEANS = [f"avg_{c}" for c in COSTS]
KPI_MEANS = TIME_MEANS + COST_MEANS
CONCEPTS = OUTCOMES + KPI_MEANS

# One concurrency cell: orders are ongoing together when they share it.
CELL = [STORE, NAME, "date"]
