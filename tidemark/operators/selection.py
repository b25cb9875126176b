"""Which stores take part, and how orders spread over stores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.functions.joins import null_safe_join


def store_order_counts(log: DataFrame) -> DataFrame:
    """Distinct orders per store, whatever their outcome.

    Catalyst first removes duplicate (store, order) pairs under a hash of both
    columns, so one huge store is counted by many tasks.
    """
    return log.groupBy(S.STORE).agg(F.count_distinct(S.ORDER).alias("orders"))


def store_order_distribution(counts: DataFrame) -> DataFrame:
    """How many stores have each number of orders."""
    return counts.groupBy("orders").agg(F.count(F.lit(1)).alias("addresses"))


def order_count_cutoff(counts: DataFrame, percentile: float) -> DataFrame:
    """One row with the exact, linearly interpolated percentile of ``orders``.

    The aggregate keeps one counter per distinct value, merged from partial
    counters. n distinct order counts need at least n(n+1)/2 orders, so the
    final state stays below the square root of twice the log's length.
    """
    return counts.agg(F.percentile("orders", F.lit(percentile)).alias("cutoff"))


def stores_above_percentile(counts: DataFrame, percentile: float) -> DataFrame:
    """Stores whose order count reaches the percentile, with their counts."""
    cutoff = order_count_cutoff(counts, percentile)
    return counts.where(F.col("orders") >= cutoff.scalar())


def top_n_stores(selected: DataFrame, n: int) -> DataFrame:
    """The ``n`` busiest of the selected stores; ties go to the smaller id."""
    return selected.orderBy(F.desc("orders"), F.asc(S.STORE)).limit(n)


def orders_of_stores(orders: DataFrame, stores: DataFrame) -> DataFrame:
    """Rows of ``orders`` whose store is in ``stores``; a NULL id matches NULL."""
    return null_safe_join(orders, stores.select(S.STORE), [S.STORE], "left_semi")


def filter_orders(log: DataFrame, store_name: str | None = None, stores: Iterable[int] | None = None) -> DataFrame:
    """Optional literal filters: one store name, or a fixed list of store ids."""
    if store_name is not None:
        log = log.where(F.col(S.NAME) == store_name)
    if stores is not None:
        log = log.where(F.col(S.STORE).isin(list(stores)))
    return log


def delivered_counts(log: DataFrame, cfg: StudyConfig) -> DataFrame:
    """Distinct delivered orders per store."""
    return store_order_counts(log.where(F.col("final_status") == cfg.delivered_status))


def store_totals(counts: DataFrame) -> DataFrame:
    """Number of stores and of their orders, in one row."""
    return counts.agg(F.count(F.lit(1)).alias("n"), F.sum("orders").alias("orders"))


def outcome_totals_by_store(summary: DataFrame) -> DataFrame:
    """Reconciliation check: outcomes of a summary table added up per store."""
    return summary.groupBy(S.STORE).agg(F.sum("delivered").alias("delivered"), F.sum("cancels").alias("cancels"))


# what rows of one order have to agree on, and how a difference is told
ORDER_FACTS = {"store": [S.STORE], "name": [S.NAME], "status": ["final_status"], "times": S.LIFECYCLE}


def conflicting_orders(log: DataFrame) -> DataFrame:
    """Order ids whose rows disagree: ``order_id, log_rows, reason``.

    Levels and distinct counts take rows of one id as one order, wherever they
    are; this lists the ids for which that is doubtful, and whether their rows
    differ in store, name, status or times. A value beside a missing one is a
    difference; rows that are alike are not. Rows without an id are no order. One
    aggregate of smallest and largest values, combined before the shuffle.
    """
    measures = [F.count(F.lit(1)).alias("log_rows")]
    differs = {}
    for reason, columns in ORDER_FACTS.items():
        for c in columns:
            measures += [F.min(c).alias(f"least_{c}"), F.max(c).alias(f"most_{c}"), F.count(c).alias(f"known_{c}")]
        differs[reason] = " OR ".join(
            f"(least_{c} <> most_{c} OR known_{c} BETWEEN 1 AND log_rows - 1)" for c in columns
        )
    told = ", ".join(f"CASE WHEN {differs[reason]} THEN '{reason}' END" for reason in ORDER_FACTS)
    found = log.where(F.col(S.ORDER).isNotNull()).groupBy(S.ORDER).agg(*measures)
    return found.selectExpr(S.ORDER, "log_rows", f"concat_ws(',', {told}) AS reason").where("reason <> ''")


def set_aside(log: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The log without the rows of conflicting orders; rows without an id stay."""
    return log.join(conflicts.select(S.ORDER), S.ORDER, "left_anti").select(*log.columns)
