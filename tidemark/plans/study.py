"""The whole analysis over one order log."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from functools import cached_property

from pyspark.sql import DataFrame

from tidemark import schema as S
from tidemark.config import StudyConfig
from tidemark.operators import concurrency, kpis, lifecycle, reports, selection, statistics, thresholds
from tidemark.operators.grid import Grid, MinuteGrid, SuppliedGrid, grid_places
from tidemark.operators.reconciliation import Ledger
from tidemark.sinks.publishing import ReportFolder, ReportViews
from tidemark.sinks.tables import REPORT_NAMES, write_report
from tidemark.staging import Staging


#: Reports that hold the outcomes of the level table, and no others.
LEVEL_REPORTS = ("report_level", "report_level_range")


class Study:
    """Tables of a saturation study, each planned when first asked for.

    The log itself is read twice: once for store order counts (two columns),
    once for the narrow rows of the selected stores. A table that feeds more
    than one step is staged first (:meth:`share`), so the work behind it is
    done once and later steps start from an input of known size.

    ``grid`` are the times of day at which orders are counted, a ``second`` of the
    day per row; every minute if not given.
    """

    def __init__(self, log: DataFrame, cfg: StudyConfig | None = None, grid: DataFrame | None = None):
        self.cfg = cfg or StudyConfig()
        self.staging = Staging(log.sparkSession)
        self._shared: set[str] = set()
        self.ledger = Ledger()
        self.whole_log = log
        self._grid_times = grid

    def share(self, *tables: str) -> None:
        """Stage the named tables before several others are built on them."""
        for name in tables:
            if name not in self._shared:
                table = getattr(self, name)
                counted = name in ("level_outcomes", "by_level", "store_kpis")
                try:
                    self.__dict__[name] = self.staging.table(self.ledger.watch(name, table) if counted else table, name)
                except BaseException:
                    self.ledger.forget(name)
                    raise
                self._shared.add(name)

    # selection

    @cached_property
    def conflicts(self) -> DataFrame:
        """Orders whose log rows disagree; staged, as they are few and a join with few needs no shuffle."""
        return self.staging.table(selection.conflicting_orders(self.whole_log), "conflicts")

    @cached_property
    def log(self) -> DataFrame:
        """The log that is studied: all of it, or with ``quarantine`` what is left without conflicting orders."""
        return selection.set_aside(self.whole_log, self.conflicts) if self.cfg.quarantine else self.whole_log

    @cached_property
    def top_stores(self) -> DataFrame:
        """Selected stores; staged so that their size is known to the semi join."""
        counts = selection.store_order_counts(self.log)
        return self.staging.table(selection.stores_above_percentile(counts, self.cfg.percentile), "top_stores")

    @cached_property
    def busiest_stores(self) -> DataFrame:
        if self.cfg.chart_stores is not None:
            return selection.filter_orders(self.top_stores, stores=self.cfg.chart_stores)
        return selection.top_n_stores(self.top_stores, self.cfg.top_n)

    @cached_property
    def selected_log(self) -> DataFrame:
        """Orders of the selected stores; the brand and store filters do not move the percentile."""
        kept = selection.orders_of_stores(self.log, self.top_stores)
        return selection.filter_orders(kept, self.cfg.store_name, self.cfg.stores)

    # order level

    @cached_property
    def orders(self) -> DataFrame:
        return lifecycle.order_facts(self.selected_log, self.cfg)

    @cached_property
    def grid(self) -> Grid:
        if self._grid_times is None:
            return MinuteGrid(self.cfg)
        return SuppliedGrid(self.staging.table(grid_places(self._grid_times, self.cfg), "grid"))

    @property
    def intervals(self) -> DataFrame:
        return concurrency.ongoing_intervals(self.orders, self.cfg, self.grid)

    @cached_property
    def curve(self) -> DataFrame:
        """How many orders are ongoing, per cell; at most 1,441 rows a store and day."""
        self.share("orders")
        return concurrency.concurrency_curve(self.intervals)

    @cached_property
    def levelled(self) -> DataFrame:
        self.share("orders")
        return concurrency.with_level(self.intervals, self.curve)

    @cached_property
    def level_sums(self) -> DataFrame:
        self.share("levelled")
        return kpis.level_sums(self.levelled)

    @cached_property
    def level_outcomes(self) -> DataFrame:
        self.share("levelled")
        return kpis.outcomes_by_level(self.levelled)

    # summaries

    @cached_property
    def store_kpis(self) -> DataFrame:
        return kpis.store_kpis_of_levels(self.level_sums, self.level_outcomes)

    @cached_property
    def store_kpis_long(self) -> DataFrame:
        return kpis.store_kpis_long(self.store_kpis)

    @cached_property
    def by_hour(self) -> DataFrame:
        self.share("orders")
        return kpis.kpis_by_hour(self.orders, self.intervals, self.curve, self.grid)

    @cached_property
    def by_date_hour(self) -> DataFrame:
        self.share("orders")
        return kpis.kpis_by_date_hour(self.orders, self.intervals, self.curve, self.grid)

    @cached_property
    def by_date_level(self) -> DataFrame:
        self.share("levelled")
        return kpis.kpis_by_date_level(self.levelled)

    @cached_property
    def by_level(self) -> DataFrame:
        return kpis.kpis_by_level_of_sums(self.level_sums, self.level_outcomes)

    @cached_property
    def r2(self) -> DataFrame:
        return statistics.kpi_r2(self.by_level, self.cfg)

    @cached_property
    def r2_long(self) -> DataFrame:
        return statistics.kpi_r2_long(self.r2)

    @cached_property
    def thresholds(self) -> DataFrame:
        return thresholds.level_thresholds(self.by_level, self.cfg)

    @cached_property
    def impacts(self) -> DataFrame:
        return thresholds.impacts(self.thresholds)

    # reports

    @cached_property
    def report_hour(self) -> DataFrame:
        self.share("curve")  # the hours read it, and the levels behind the stores' values
        return reports.report_hour(self.by_hour, self.store_kpis_long, self.cfg)

    @cached_property
    def report_level(self) -> DataFrame:
        self.share("by_level")
        return reports.report_level(
            self.by_level, self.store_kpis_long, self.r2_long, reports.levels_of(self.by_level)
        )

    @cached_property
    def report_level_range(self) -> DataFrame:
        self.share("by_level")
        return reports.report_level_range(self.by_level, self.store_kpis_long, self.r2_long, self.cfg)

    @cached_property
    def scatter_sample(self) -> DataFrame:
        return reports.scatter_sample(self.by_level, self.cfg.scatter_rows)

    @cached_property
    def store_suggestions(self) -> DataFrame:
        totals = kpis.store_wtp_totals(self.store_kpis)
        return thresholds.store_suggestions(self.impacts, totals, self.cfg)

    def write_reports(
        self,
        folder: str | None = None,
        fmt: str = "parquet",
        tables: str | None = None,
        only: Collection[str] = tuple(REPORT_NAMES.values()),
    ) -> list[str]:
        """Write the four published reports, or some of them, below ``folder`` or as catalog tables.

        ``tables`` is what the tables' names begin with: ``"sales."`` for a schema,
        ``"sales.june_"`` for a schema and a prefix.
        """
        self._one_place(folder, tables)
        written = []
        for name, report in self._reports(only):
            if tables is not None:
                written.append(f"{tables}{name}")
                write_report(report, table=written[-1], fmt=fmt)
            else:
                written.append(f"{folder.rstrip('/')}/{name}")
                write_report(report, path=written[-1], fmt=fmt)
        return written

    def publish_reports(
        self, folder: str | None = None, fmt: str = "parquet", tables: str | None = None, keep: int = 1
    ) -> list[str]:
        """Publish the four reports as one set, which replaces the last one when all of it is written.

        Readers use :class:`ReportFolder`, or the views named by ``tables`` and the
        report. ``keep`` earlier sets stay for those who still read them.
        """
        self._one_place(folder, tables)
        spark = self.whole_log.sparkSession
        place = ReportFolder(spark, folder) if tables is None else ReportViews(spark, tables)
        return place.publish(self._reports(), fmt, keep)

    @staticmethod
    def _one_place(folder: str | None, tables: str | None) -> None:
        if (folder is None) == (tables is None):
            raise ValueError("give either a folder or a beginning of table names")

    def _reports(self, only: Collection[str] = tuple(REPORT_NAMES.values())) -> Iterator[tuple[str, DataFrame]]:
        """Names of the published reports and their rows in order; what they share is staged first.

        Outcome totals are compared before the first report and behind each: a
        difference that the definitions don't explain ends the writing.
        """
        self.ledger.forget(*LEVEL_REPORTS)
        self.share("curve", "level_sums", "level_outcomes", "by_level", "store_kpis")
        self.ledger.check()
        for attribute, name in REPORT_NAMES.items():
            if name in only:
                report = getattr(self, attribute)
                report = report.orderBy(*[c for c in (S.STORE, S.NAME, "concept") if c in report.columns])
                yield name, self.ledger.watch(attribute, report) if attribute in LEVEL_REPORTS else report
                self.ledger.check()

    def __enter__(self) -> Study:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Delete the staged tables; results read from them must be written first."""
        self.staging.drop()
