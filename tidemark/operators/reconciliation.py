"""Outcome totals that the tables of one study must share, seen while they are written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark import schema as S


class ReconciliationError(Exception):
    """Tables of one study count different orders."""


@dataclass(frozen=True)
class Totals:
    """Rows of a table and its outcomes added up; ``cancels`` is None where a table does not hold them."""

    rows: int
    delivered: float
    cancels: float | None

    def agrees(self, other: Totals) -> bool:
        both = self.cancels is not None and other.cancels is not None
        return self.delivered == other.delivered and (not both or self.cancels == other.cancels)


def _added(expression: str) -> str:
    return f"coalesce(sum(CAST({expression} AS DOUBLE)), 0D)"


class Ledger:
    """Totals by table, as metrics of the jobs that write the tables: no table is read once more.

    What must hold, by the definitions:

    * outcomes of a store are those of its levels, as an order has one level;
    * the level table repeats the outcomes of a (store, level) for each name that
      the store has there, so it has them once if it has as many rows as the
      outcomes by level, and at least once otherwise;
    * both level reports are the level table, turned.

    The hour report counts all orders by the hour of their activation, also those
    that were never ongoing, and is not held against the others.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, name: str, table: DataFrame) -> DataFrame:
        """The same rows; their totals are known when a job has written them.

        This has to be the last step before the writer, as what stands below a
        sort is run once more to find its borders.
        """
        delivered, cancels = S.OUTCOMES
        if "concept" in table.columns:  # a report: outcomes stand in rows, levels or ranges beside each other
            lead = {S.STORE, S.NAME, "concept", "r2", "value"}
            cells = ", ".join(f"`{c}`" for c in table.columns if c not in lead)
            across = f"aggregate(array({cells}), 0D, (a, x) -> a + coalesce(x, 0D))" if cells else "0D"
            of = {c: f"IF(concept = '{c}', {across}, 0D)" for c in S.OUTCOMES}
            present = f"max(IF(concept = '{cancels}', 1, 0))"
        else:
            of, present = {c: c for c in S.OUTCOMES}, "1"
        measures = [
            F.count(F.lit(1)).alias("rows"),
            F.expr(_added(of[delivered])).alias("delivered"),
            F.expr(f"CASE WHEN {present} = 1 THEN {_added(of[cancels])} END").alias("cancels"),
        ]
        self._seen[name] = Observation()
        return table.observe(self._seen[name], *measures)

    def forget(self, *names: str) -> None:
        """Tables that are written anew, or were not written in the end: their totals are not waited for."""
        for name in names:
            self._seen.pop(name, None)

    def totals(self, name: str) -> Totals | None:
        return Totals(**self._seen[name].get) if name in self._seen else None

    def check(self) -> dict[str, Totals]:
        """All totals so far; raises if some differ that may not."""
        found = {name: self.totals(name) for name in self._seen}
        levels, stores, table = (found.get(name) for name in ("level_outcomes", "store_kpis", "by_level"))
        wrong = []
        if levels and stores and not levels.agrees(stores):
            wrong.append(("level_outcomes", "store_kpis"))
        if levels and table and not levels.agrees(table):
            repeated = table.rows > levels.rows and table.delivered >= levels.delivered and table.cancels >= levels.cancels
            if not repeated:
                wrong.append(("level_outcomes", "by_level"))
        for report in ("report_level", "report_level_range"):
            if table and report in found and not table.agrees(found[report]):
                wrong.append(("by_level", report))
        if wrong:
            told = "; ".join(f"{a} {found[a]} and {b} {found[b]}" for a, b in wrong)
            raise ReconciliationError(f"totals differ: {told}")
        return found
