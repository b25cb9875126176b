"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import os
import random
import re

import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from tidemark import Study, StudyConfig
from tidemark.operators import concurrency, kpis, lifecycle, selection


@pytest.fixture(scope="module")
def study(spark):
    made = Study(entry._log(spark, SF_DIR), StudyConfig(percentile=0.5))
    made.share("orders", "levelled")
    yield made
    made.close()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def tables(study):
    return {
        "counts": selection.store_order_counts(study.log),
        "orders": lifecycle.order_facts(study.selected_log, study.cfg),
        "minutes": concurrency.ongoing_minutes(study.intervals),
        "concurrency": concurrency.ongoing_concurrency(study.intervals),
        "levels": concurrency.with_level(study.intervals),
        "store_kpis": kpis.store_kpis(study.intervals),
        "by_hour": study.by_hour,
        "by_level": kpis.kpis_by_level(study.levelled),
        "impacts": study.impacts,
        "suggestions": study.store_suggestions,
        "report_hour": study.report_hour,
        "report_range": study.report_level_range,
    }


def test_no_cross_joins_and_no_python(study):
    for name, df in tables(study).items():
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


def test_selection_reads_two_columns(study):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(selection.store_order_counts(study.log)))
    assert schemas[0].replace(" ", "") == "o_orderkey:bigint,o_custkey:bigint"


def test_selected_orders_need_no_shuffle(study):
    """Selected store ids are few and their size is known: the log is filtered where it is read."""
    text = plan(lifecycle.order_facts(study.selected_log, study.cfg))
    body = text.split("Subquery")[0]
    assert "BroadcastHashJoin" in body and "LeftSemi" in body
    assert "Exchange hashpartitioning" not in text


def test_large_selection_falls_back_to_a_shuffled_join(spark, study):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan(lifecycle.order_facts(study.selected_log, study.cfg))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_level_table_prunes_columns_and_combines_before_shuffling(study):
    text = plan(kpis.kpis_by_level(study.levelled))
    assert "partial_sum" in text and "partial_max" in text
    assert "known_id" not in text and "dispatch_tod" not in text


def test_curve_combines_events_before_the_shuffle(study):
    text = plan(concurrency.concurrency_curve(study.intervals))
    assert text.count("Exchange hashpartitioning") == 2
    assert text.index("functions=[partial_sum(step") > text.index("Exchange hashpartitioning")
    assert "explode" not in text


def test_grid_counts_make_two_rows_an_order(study):
    """Events, not a row per order and minute; the only other rows made are minutes of the day."""
    counted = concurrency.ongoing_per_minute(study.orders)
    text = plan(counted)
    assert text.count("Generate inline") == text.count("Generate explode") == 1
    assert "functions=[partial_sum(step" in text
    assert text.index("Generate explode") < text.index("Window") < text.index("Generate inline")


def test_reports_build_the_curve_once(spark, tmp_path):
    made = Study(entry._log(spark, SF_DIR), StudyConfig(percentile=0.5))
    made.write_reports(str(tmp_path))
    for table in (made.by_hour, made.levelled):
        assert "lead(minute" not in plan(table)
    per_store = kpis.store_kpis_of_levels(made.level_sums, made.level_outcomes)
    read = {os.path.basename(os.path.dirname(file)) for file in per_store.inputFiles()}
    assert read == {"level_sums", "level_outcomes"}
    made.close()


def test_thresholds_share_one_partitioning(study):
    """Both window rounds and the impact aggregation use a single shuffle."""
    study.share("by_level")
    from tidemark.operators import thresholds

    table = thresholds.level_thresholds(study.by_level, study.cfg)
    assert plan(thresholds.impacts(table)).count("Exchange hashpartitioning") == 1


def test_a_repeated_id_and_a_hot_cell_are_split(spark):
    """A third of the rows have no id, a third share store, date and minutes: the joins split those partitions."""
    from builders import log_of, order

    from tidemark import schema as S

    draw = random.Random(1)
    rows = []
    for i in range(12_000):
        day, minute = f"06-0{1 + i % 3}", f"{draw.randint(0, 50):02d}"
        spread = order(i, f"{day} 12:{minute}:00", f"{day} 12:55:00", store=1 + i % 40)
        no_id = spread | {S.ORDER: None}
        hot = order(draw.randint(10**6, 10**12), "06-01 12:10:00", "06-01 12:12:00")
        rows.append((spread, no_id, hot)[i % 3] | {"cpo": draw.random(), "cm0": draw.random()})
    made = Study(log_of(spark, rows).repartition(8), StudyConfig(percentile=0.0))
    made.share("orders")
    want = {r[S.ORDER]: r[S.LEVEL] for r in concurrency.with_level(made.intervals).collect()}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "16k",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        levelled = concurrency.with_level(made.intervals)
        got = {r[S.ORDER]: r[S.LEVEL] for r in levelled.collect()}
        joins = re.findall(r"SortMergeJoin(\(skew=true\))?", plan(levelled).split("Initial Plan")[0])
        assert joins.count("(skew=true)") == 2, joins
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want and None in got
    made.close()
