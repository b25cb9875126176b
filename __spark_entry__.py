"""Registered queries and the SQL they are checked against.

The order log is derived from the ``orders`` table. Queries downstream of the
store selection run at the default percentile (0.95) and, with the suffix
``_p50``, on the busier half of the stores, where more branches occur.

Means of times, which come from whole microseconds, are published as they are.
What engines add up in different orders is rounded, sums and means of doubles to
6 decimals and coefficients to 7, which leaves whole numbers whole. Dates are
published as ISO text, whole numbers with NULLs as doubles.

Building a query on a study runs jobs: the tables that several of its steps read
are staged in the shared folder first. They stay as long as results may be read
from them, and go with the session.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle_queries  # noqa: E402
from tidemark import Study, StudyConfig  # noqa: E402
from tidemark import schema as S  # noqa: E402
from tidemark.functions.columns import level_range  # noqa: E402
from tidemark.operators import concurrency, kpis, lifecycle, reports, selection, statistics, thresholds  # noqa: E402
from tidemark.sinks.tables import REPORT_NAMES  # noqa: E402
from tidemark.sources import order_log  # noqa: E402
from tidemark.sources.orders_table import order_log_from_orders  # noqa: E402
from tidemark.staging import Staging  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]
GROUP = [S.STORE, S.NAME]


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log_from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet"))


#: Quotients of whole numbers: equal on both engines to the last digit.
EXACT = {*S.TIME_MEANS, *(d.name for d in S.DURATIONS), "mean_ongoing"}


def _publish(
    df: DataFrame, absolute: tuple[str, ...] = (), as_double: tuple[str, ...] = (), exact: Collection[str] = EXACT
) -> DataFrame:
    def shown(field: T.StructField) -> str:
        name = f"`{field.name}`"
        if isinstance(field.dataType, T.DateType):
            return f"CAST({name} AS STRING) AS {name}"
        if field.name in as_double:
            return f"CAST({name} AS DOUBLE) AS {name}"
        if not isinstance(field.dataType, T.DoubleType) or field.name in exact:
            return name
        if field.name in absolute:
            return f"round({name}, 7) + 0.0D AS {name}"
        return f"round({name} + {oracle_queries.OFF_TIES}D, 6) + 0.0D AS {name}"

    return df.selectExpr(*[shown(f) for f in df.schema.fields])


def _published(name: str, df: DataFrame) -> DataFrame:
    """The result of query ``name`` in its published types and precision."""
    coefficients = tuple(S.CONCEPTS) if name == "kpi_r2" else ("r2", "corr")
    nullable = tuple(oracle_queries.NULLABLE_COUNTS.get(name, ()))
    means_of_means = name in ("kpi_r2", "kpis_by_level_range")
    return _publish(df, coefficients, nullable, () if means_of_means else EXACT)


# --- queries on the log ----------------------------------------------------


def _as_csv_text(log: DataFrame) -> DataFrame:
    """Timestamps written the way CSV logs hold them, in all forms that are read, blanks included."""

    def text(c: str) -> str:
        forms = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss", "yyyyMMdd HH:mm:ss"]
        forms += ["yyyy-MM-dd hh:mm:ss a", "yyyy-MM-dd'T'HH:mm:ss'Z'"]
        cases = " ".join(f"""WHEN {i} THEN date_format({c}, "{form}")""" for i, form in enumerate(forms))
        away = f"""date_format({c} - INTERVAL '5' HOUR, "yyyy-MM-dd'T'HH:mm:ss'-05:00'")"""
        return f"coalesce(CASE {S.ORDER} % {len(forms) + 1} {cases} ELSE {away} END, '')"

    return log.withColumns({c: F.expr(text(c)) for c in S.LIFECYCLE})


def _grid_counts(orders: DataFrame, grid: DataFrame) -> DataFrame:
    """Grid minutes with the number of orders ongoing at each."""
    counted = grid.join(concurrency.ongoing_per_minute(orders), "minute", "left")
    return counted.withColumn("order_minutes", F.coalesce("order_minutes", F.lit(0).cast("bigint")))


def _minute_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = lifecycle.order_facts(_log(spark, sf_dir), StudyConfig())
    return _grid_counts(orders, order_log.minute_grid(spark)).select("hourmin", "minute", "order_minutes")


def _working_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    study = Study(_log(spark, sf_dir))
    grid = order_log.working_minutes(
        order_log.minute_grid(spark), study.cfg.open_hour, study.cfg.close_hour
    )
    orders = lifecycle.order_facts(study.selected_log, study.cfg)
    return _grid_counts(orders, grid.drop("hourmin")).select("minute", "hour", "order_minutes")


#: Names as logs hold them: with commas, quotes, line feeds and backslashes, blank or missing.
ODD_NAME = r"""CASE order_id % 8 WHEN 0 THEN concat(store_name, ', "east" side') WHEN 1 THEN concat('"', store_name, '"')
    WHEN 2 THEN concat(store_name, char(10), char(9), 'upper floor') WHEN 3 THEN concat(store_name, char(92), 'n')
    WHEN 4 THEN NULL ELSE store_name END"""
#: What a CSV log writes for them: C escapes for backslashes and control characters.
ESCAPED = r"""replace(replace(replace(store_name, char(92), concat(char(92), char(92))),
    char(10), concat(char(92), 'n')), char(9), concat(char(92), 'x09'))"""


def _order_log_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with odd names, written as CSV files and read back; its columns stand in another order."""
    log = _log(spark, sf_dir).withColumn(S.NAME, F.expr(ODD_NAME))
    text = _as_csv_text(log).withColumn(S.NAME, F.expr(ESCAPED)).withColumn("remark", F.lit("a, b"))
    path = f"{Staging(spark).root}/log_csv"
    writer = text.select(sorted(text.columns)).repartition(5).write.option("header", True)
    writer.option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv(path)
    return lifecycle.parse_lifecycle(order_log.read_order_log_csv(spark, path))


def _repeated(log: DataFrame) -> DataFrame:
    """A log in which every sixth order stands twice: alike, or with another store, name, status or time."""
    twice = log.selectExpr("*", f"explode(IF({S.ORDER} % 6 = 0, array(0, 1), array(0))) AS copy")
    other = {
        S.STORE: (4, f"{S.STORE} + 1"),
        S.NAME: (5, "CAST(NULL AS STRING)"),
        "final_status": (7, "'CanceledStatus'"),
        "pickup_time_local": (9, "pickup_time_local + INTERVAL '1' SECOND"),
    }
    changed = {
        c: F.expr(f"CASE WHEN copy = 1 AND {S.ORDER} DIV 6 % {n} = 0 THEN {value} ELSE {c} END")
        for c, (n, value) in other.items()
    }
    return twice.withColumns(changed).drop("copy")


def _log_queries() -> dict[str, Query]:
    cfg = StudyConfig()
    durations = [d.name for d in S.DURATIONS]

    def on_log(build: Callable[[DataFrame], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(_log(spark, sf_dir))

    def cut(counts: DataFrame) -> DataFrame:
        return selection.stores_above_percentile(counts, cfg.percentile)

    def top_n(log: DataFrame) -> DataFrame:
        return selection.top_n_stores(cut(selection.store_order_counts(log)), cfg.top_n)

    def named(log: DataFrame) -> DataFrame:
        return selection.filter_orders(log, store_name="STORE_7").select(S.ORDER, S.STORE, S.NAME)

    def clock(log: DataFrame) -> DataFrame:
        return _published("time_of_day", lifecycle.clock_times(log).select(S.ORDER, "dispatch_tod", "pickup_tod"))

    def flags(log: DataFrame) -> DataFrame:
        return _published("status_flags", lifecycle.status_flags(log, cfg).select(S.ORDER, *S.OUTCOMES))

    def timed(log: DataFrame) -> DataFrame:
        return _publish(lifecycle.duration_minutes(lifecycle.duration_micros(log)).select(S.ORDER, *durations))

    return {
        "order_log_scan": on_log(order_log.normalise),
        "order_log_csv": _order_log_csv,
        "conflicting_orders": on_log(lambda log: selection.conflicting_orders(_repeated(log))),
        "store_order_counts_quarantined": on_log(
            lambda log: selection.store_order_counts(Study(_repeated(log), StudyConfig(quarantine=True)).log)
        ),
        "parse_lifecycle": on_log(lambda log: lifecycle.parse_lifecycle(_as_csv_text(log)).select(S.ORDER, *S.LIFECYCLE)),
        "time_of_day": on_log(clock),
        "status_flags": on_log(flags),
        "duration_kpis": on_log(timed),
        "minute_grid": _minute_grid,
        "working_minutes": _working_minutes,
        "store_order_counts": on_log(selection.store_order_counts),
        "top_stores_percentile": on_log(lambda log: cut(selection.store_order_counts(log))),
        "top_n_stores": on_log(top_n),
        "orders_of_top_stores": on_log(lambda log: Study(log, cfg).selected_log.select(S.ORDER, S.STORE)),
        "orders_of_named_store": on_log(named),
        "store_totals": on_log(lambda log: selection.store_totals(selection.delivered_counts(log, cfg))),
        "store_totals_percentile": on_log(lambda log: selection.store_totals(cut(selection.delivered_counts(log, cfg)))),
        "store_order_distribution": on_log(
            lambda log: selection.store_order_distribution(selection.delivered_counts(log, cfg))
        ),
    }


# --- queries on a study ----------------------------------------------------


def _reconcile(study: Study) -> DataFrame:
    study.share("levelled")
    summaries = {
        "outcomes_by_date_hour": kpis.outcomes_by_date_hour(study.orders),
        "outcomes_by_date_level": kpis.outcomes_by_date_level(study.levelled),
        "kpis_by_date_hour": study.by_date_hour,
        "kpis_by_date_level": study.by_date_level,
        "outcomes_by_hour": kpis.outcomes_by_hour(study.orders),
        "outcomes_by_level": kpis.outcomes_by_level(study.levelled),
        "kpis_by_hour": study.by_hour,
        "kpis_by_level": study.by_level,
    }
    totals = [
        selection.outcome_totals_by_store(table).select(F.lit(name).alias("summary"), S.STORE, *S.OUTCOMES)
        for name, table in summaries.items()
    ]
    return reduce(DataFrame.unionByName, totals)


#: Fewer than the level table has, so that the sample is one.
SAMPLED_ROWS = 25


def _study_tables() -> dict[str, Callable[[Study], DataFrame]]:
    """One builder per query; each works on a study of its own."""
    level_keys = [*GROUP, S.LEVEL]

    def ranges(study: Study) -> DataFrame:
        return reports.kpis_by_level_range(study.by_level, study.cfg)

    def levels(study: Study) -> DataFrame:
        label = level_range(S.LEVEL, study.cfg)
        return study.by_level.selectExpr(*level_keys, f"{label} AS level_range")

    def long_levels(study: Study) -> DataFrame:
        study.share("by_level")
        return reports.report_level_long(study.by_level, study.store_kpis_long, study.r2_long)

    def impact_part(column: str) -> Callable[[Study], DataFrame]:
        return lambda study: study.impacts.select(*GROUP, "concept", column)

    def on_shared_orders(build: Callable[[DataFrame], DataFrame]) -> Callable[[Study], DataFrame]:
        def run(study: Study) -> DataFrame:
            study.share("orders")
            return build(study.intervals)

        return run

    def written(report: str) -> Callable[[Study], DataFrame]:
        def run(study: Study) -> DataFrame:
            (path,) = study.write_reports(f"{study.staging.root}/reports", only=[report])
            found = study.log.sparkSession.read.parquet(path)
            return reports.unfolded(found) if report == REPORT_NAMES["report_level"] else found

        return run

    tables: dict[str, Callable[[Study], DataFrame]] = {
        "reconcile_by_store": _reconcile,
        "ongoing_minutes": on_shared_orders(
            lambda intervals: concurrency.ongoing_minutes(intervals).select(S.ORDER, *S.CELL, "minute")
        ),
        "ongoing_concurrency": on_shared_orders(concurrency.ongoing_concurrency),
        "order_level": on_shared_orders(concurrency.order_levels),
        "store_kpis": lambda s: s.store_kpis,
        "store_kpis_long": lambda s: s.store_kpis_long,
        "store_wtp_totals": lambda s: kpis.store_wtp_totals(s.store_kpis),
        "outcomes_by_date_hour": lambda s: kpis.outcomes_by_date_hour(s.orders),
        "outcomes_by_date_level": lambda s: kpis.outcomes_by_date_level(s.levelled),
        "outcomes_by_hour": lambda s: kpis.outcomes_by_hour(s.orders),
        "outcomes_by_level": lambda s: kpis.outcomes_by_level(s.levelled),
        "kpis_by_date_hour": lambda s: s.by_date_hour,
        "kpis_by_date_level": lambda s: s.by_date_level,
        "kpis_by_hour": lambda s: s.by_hour,
        "kpis_by_level": lambda s: s.by_level,
        "kpi_r2": lambda s: s.r2,
        "kpi_r2_long": lambda s: s.r2_long,
        "level_kpi_correlation": lambda s: statistics.level_kpi_correlation(s.by_level),
        "level_kpi_correlation_strict": lambda s: statistics.level_kpi_correlation_strict(s.by_level),
        "threshold_argmax": lambda s: s.thresholds.select(*level_keys, "threshold_dispatch", "threshold_accept"),
        "threshold_second_exceedance": lambda s: s.thresholds.select(
            *level_keys, "threshold_wtp", "threshold_prep_time"
        ),
        "level_thresholds": lambda s: s.thresholds,
        "thresholds_long": impact_part("threshold"),
        "lost_orders_long": impact_part("lost_orders"),
        "wtp_impact_long": impact_part("wtp_impact"),
        "impacts": lambda s: s.impacts,
        "store_suggestions": lambda s: s.store_suggestions,
        "report_hour": lambda s: s.report_hour,
        "report_level": lambda s: reports.unfolded(s.report_level),
        "report_level_long": long_levels,
        "level_range": levels,
        "kpis_by_level_range": ranges,
        "cumulative_by_range": lambda s: reports.cumulative_by_range(ranges(s)).select(
            *GROUP, "level_range", "delivered", "accum", "perc"
        ),
        "report_level_range": lambda s: s.report_level_range,
        "series_times": lambda s: reports.series_times(s.by_level, s.busiest_stores),
        "series_orders": lambda s: reports.series_orders(s.by_level, s.busiest_stores),
        "series_costs": lambda s: reports.series_costs(s.by_level, s.busiest_stores),
        "scatter_input": lambda s: reports.scatter_input(s.by_level),
        "scatter_sample": lambda s: reports.scatter_sample(s.by_level, SAMPLED_ROWS),
    }
    for report in REPORT_NAMES.values():
        tables[f"written_{report.lower()}"] = written(report)
    for suffix in thresholds.THRESHOLD_KPIS:
        tables[f"impact_{suffix}"] = lambda s, suffix=suffix: thresholds.impact(s.thresholds, suffix)
    return tables


def _study_query(name: str, build: Callable[[Study], DataFrame], cfg: StudyConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _published(name, build(Study(_log(spark, sf_dir), cfg)))

    return run


def _uneven_grid(spark: SparkSession) -> DataFrame:
    """Every third minute without those from 12:45 to 13:14, and two times between minutes."""
    minutes = order_log.minute_grid(spark).where("minute % 3 = 0 AND minute NOT BETWEEN 765 AND 794").select("hourmin")
    between = spark.range(2).selectExpr("concat('13:0', 5 + 2 * id, ':30') AS hourmin")
    return order_log.with_second(minutes.union(between))


def _grid_tables() -> dict[str, Callable[[Study], DataFrame]]:
    """Queries of a study that counts orders at the times of a supplied grid."""

    def concurrent(study: Study) -> DataFrame:
        study.share("orders")
        found = concurrency.ongoing_concurrency(study.intervals, study.curve, study.grid)
        return study.grid.on_clock(found)

    return {
        "ongoing_concurrency_grid": concurrent,
        "kpis_by_level_grid": lambda s: s.by_level,
        "kpis_by_hour_grid": lambda s: s.by_hour,
        "store_suggestions_grid": lambda s: s.store_suggestions,
    }


def _grid_query(name: str, build: Callable[[Study], DataFrame], cfg: StudyConfig) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _published(name, build(Study(_log(spark, sf_dir), cfg, _uneven_grid(spark))))

    return run


#: One brand of the stores above a percentile of all stores.
NAMED = StudyConfig(percentile=0.2, store_name="STORE_12")
NAMED_QUERIES = ("kpis_by_level", "store_suggestions")


def entry(spark: SparkSession) -> DataFrame:
    """KPIs per store, name and level of concurrency."""
    return queries()["kpis_by_level"](spark, "/root/testdata/sf0.001")


def _training_data() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL of the subpackage ``llm`` and its pipeline; none where they are not installed."""
    try:
        import tidemark.llm.queries as llm
    except ModuleNotFoundError as missing:
        if missing.name not in ("tidemark.llm", "tidemark.llm.queries"):
            raise
        return {}, {}
    found, sql = dict(llm.QUERIES), dict(llm.ORACLES)
    try:
        import corpus_pipeline
    except ModuleNotFoundError as missing:
        if missing.name != "corpus_pipeline":
            raise
    else:
        found["pipeline"] = corpus_pipeline.run
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, sql


def queries() -> dict[str, Query]:
    """One callable per query; those on a study run staging jobs when called, see above."""
    found = _log_queries()
    for name, build in _study_tables().items():
        found[name] = _study_query(name, build, StudyConfig())
        found[f"{name}_p50"] = _study_query(name, build, StudyConfig(percentile=0.5))
        if name in NAMED_QUERIES:
            found[f"{name}_named"] = _study_query(name, build, NAMED)
    for name, build in _grid_tables().items():
        found[name] = _grid_query(name, build, StudyConfig())
        found[f"{name}_p50"] = _grid_query(name, build, StudyConfig(percentile=0.5))
    return {**found, **_training_data()[0]}


def oracle_sql() -> dict[str, str]:
    half = {f"{name}_p50": sql for name, sql in oracle_queries.study_sql(0.5).items()}
    brand = oracle_queries.study_sql(NAMED.percentile, NAMED.store_name)
    named = {f"{name}_named": brand[name] for name in NAMED_QUERIES}
    own = {**oracle_queries.selection_sql(0.95), **oracle_queries.study_sql(0.95), **half, **named}
    own |= oracle_queries.grid_sql(0.95) | {f"{name}_p50": sql for name, sql in oracle_queries.grid_sql(0.5).items()}
    return {**own, **_training_data()[1]}
