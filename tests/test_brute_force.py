"""Operators against the definitions, on logs full of awkward rows."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import brute_force as B
import pytest
from builders import log_of

from tidemark import Study, StudyConfig
from tidemark import schema as S
from tidemark.operators import concurrency, kpis


def random_log(seed: int, size: int = 400, hot_store: bool = True) -> list[dict]:
    """Repeated order ids, missing ids, names, dates and times, a store with half of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        store = 1 if hot_store and rng.random() < 0.5 else rng.randint(1, 6)
        act = datetime(2020, 6, rng.randint(1, 2), rng.choice([6, 12, 12, 13, 20, 23]), rng.randint(0, 59), rng.randint(0, 59))
        act += timedelta(microseconds=rng.choice([0, 0, 250_000]))
        sent = act + timedelta(seconds=rng.randint(0, 200))
        picked = sent + timedelta(seconds=rng.choice([0, 30, 600, 1800, 5400, 90_000]) + rng.randint(0, 300))
        arrived = picked - timedelta(seconds=rng.randint(-60, 1500))

        def maybe(value, chance=0.1):
            return None if rng.random() < chance else value

        rows.append(
            {
                S.STORE: store,
                S.NAME: rng.choice(["A", "A", "B", None]),
                S.ORDER: maybe(rng.choice([i, i, i, i // 7]), 0.05),
                "final_status": rng.choice(["DeliveredStatus"] * 4 + ["CanceledStatus", "Other", None]),
                "activation_time_local": maybe(act, 0.05),
                "partner_dispatch_time_local": maybe(sent, 0.05),
                "partner_accepted_time_local": maybe(sent + timedelta(seconds=rng.randint(0, 500)), 0.3),
                "enters_pickup_local": maybe(arrived),
                "pickup_time_local": maybe(picked),
                "delivery_time_local": maybe(picked + timedelta(seconds=600), 0.4),
                "cpo": maybe(round(rng.uniform(1, 5), 2), 0.3),
                "cm0": maybe(rng.uniform(-1, 1), 0.3),
            }
        )
    return rows


def close(found: dict, want: dict) -> None:
    assert found.keys() == want.keys()
    for key, values in want.items():
        assert list(found[key]) == [v if v is None else pytest.approx(v, abs=1e-9) for v in values], key


def table(df, keys, values):
    out = {}
    for r in df.collect():
        key = tuple(r[k] for k in keys)
        assert key not in out, f"duplicate group {key}"
        out[key] = [r[v] for v in values]
    return out


@pytest.mark.parametrize("seed, broadcast", [(1, True), (2, False), (3, True)])
def test_against_definitions(spark, seed, broadcast):
    rows = random_log(seed)
    stores = B.top_stores(rows, 0.3)
    detail = B.detail(rows, stores)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        if not broadcast:  # every join shuffles
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        study = Study(log_of(spark, rows), StudyConfig(percentile=0.3))
        assert {r[S.STORE] for r in study.top_stores.collect()} == stores

        study.share("orders")
        found = concurrency.ongoing_concurrency(study.intervals).collect()
        assert sorted(
            repr((r[S.ORDER], r[S.STORE], r[S.NAME], r["date"], r["minute"], r[S.LEVEL])) for r in found
        ) == sorted(
            repr((d["order"], d["store"], d["name"], d["date"], d["minute"], d["ongoing"])) for d in detail
        )
        levels = {(r[S.ORDER], r[S.LEVEL]) for r in concurrency.order_levels(study.intervals).collect()}
        assert levels == {(d["order"], d["level"]) for d in detail}

        close(table(study.store_kpis, [S.STORE], S.KPI_MEANS), B.kpi_means(detail, ["store"]))
        close(table(study.store_kpis, [S.STORE], S.OUTCOMES), B.outcomes(detail, ["store"]))

        close(
            table(study.by_level, [S.STORE, S.NAME, S.LEVEL], S.KPI_MEANS),
            B.kpi_means(detail, ["store", "name", "level"]),
        )
        close(
            table(kpis.outcomes_by_level(study.levelled), [S.STORE, S.LEVEL], S.OUTCOMES),
            B.outcomes(detail, ["store", "level"]),
        )
        close(
            table(study.by_date_level, [*S.CELL, S.LEVEL], S.KPI_MEANS),
            B.kpi_means(detail, ["store", "name", "date", "level"]),
        )
        hourly = B.group(detail, ["store", "name", "hour"])
        close(
            table(study.by_hour, [S.STORE, S.NAME, "hour"], ["avg_ongoing_orders", *S.KPI_MEANS]),
            {
                k: [B.mean([d["ongoing"] for d in ds]), *[B.mean([d[m] for d in ds]) for m in B.KPIS]]
                for k, ds in hourly.items()
            },
        )
        daily = B.group(detail, ["store", "name", "date", "hour"])
        close(
            table(study.by_date_hour, [*S.CELL, "hour"], ["avg_ongoing_orders"]),
            {k: [B.mean([d["ongoing"] for d in ds])] for k, ds in daily.items()},
        )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_level_counts_add_up_to_store_counts(spark):
    study = Study(log_of(spark, random_log(4)), StudyConfig(percentile=0.0))
    by_level = kpis.outcomes_by_level(study.levelled).groupBy(S.STORE).sum(*S.OUTCOMES)
    total = {r[0]: (r[1], r[2]) for r in by_level.collect()}
    assert total == {r[S.STORE]: (r["delivered"], r["cancels"]) for r in study.store_kpis.collect()}


def test_grid_join_equals_interval_expansion(spark):
    from tidemark.sources.order_log import minute_grid, working_minutes

    study = Study(log_of(spark, random_log(5)), StudyConfig(percentile=0.0))
    study.share("orders")
    columns = [S.ORDER, *S.CELL, "minute"]
    by_interval = concurrency.ongoing_minutes(study.intervals).select(*columns)
    by_grid = concurrency.ongoing_minutes_on_grid(study.orders, working_minutes(minute_grid(spark), 7, 21))
    by_grid = by_grid.select(*columns)
    assert by_interval.exceptAll(by_grid).count() == 0
    assert by_grid.exceptAll(by_interval).count() == 0
    assert by_grid.count() > 0


def test_empty_log(spark):
    study = Study(log_of(spark, []), StudyConfig())
    for result in (study.report_hour, study.report_level, study.report_level_range, study.store_suggestions):
        assert result.count() == 0
