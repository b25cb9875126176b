"""Hand-computed cases."""

from __future__ import annotations

import math

import pytest
from builders import at, level_table, log_of, order
from pyspark.sql import functions as F

from tidemark import StudyConfig
from tidemark import schema as S
from tidemark.functions.aggregates import r_squared
from tidemark.functions.columns import level_range, level_range_labels, unescape
from tidemark.operators import concurrency, kpis, lifecycle, reports, selection, statistics, thresholds

CFG = StudyConfig()


def facts(spark, rows):
    return lifecycle.order_facts(log_of(spark, rows), CFG)


def test_interval_to_minutes(spark):
    cases = {
        1: ("06-01 10:00:00", "06-01 10:03:00", [600, 601, 602]),
        2: ("06-01 10:00:01", "06-01 10:02:00", [601]),
        3: ("06-01 10:00:10", "06-01 10:00:50", []),
        4: ("06-01 23:50:00", "06-02 00:10:00", []),
        5: ("06-01 06:58:00", "06-01 07:02:00", [420, 421]),
        6: ("06-01 20:58:30", "06-01 21:05:00", [1259]),
        7: ("06-01 10:00:00", None, []),
        8: ("06-01 10:00:00", "06-02 10:02:00", [600, 601]),
        9: ("06-01 10:00:00.9", "06-01 10:01:00.2", [600]),
        10: ("06-01 19:00:00", "06-02 08:00:00", []),
    }
    orders = facts(spark, [order(i, d, p) for i, (d, p, _) in cases.items()])
    found = {i: [] for i in cases}
    for row in concurrency.ongoing_minutes(concurrency.ongoing_intervals(orders, CFG)).collect():
        found[row[S.ORDER]].append(row["minute"])
    assert {i: sorted(m) for i, m in found.items()} == {i: want for i, (_, _, want) in cases.items()}


def test_levels_and_hourly_mean(spark):
    orders = facts(
        spark, [order(1, "06-01 10:00:00", "06-01 10:03:00"), order(2, "06-01 10:01:00", "06-01 10:03:00")]
    )
    intervals = concurrency.ongoing_intervals(orders, CFG)
    levels = {r[S.ORDER]: (r["mean_ongoing"], r[S.LEVEL]) for r in concurrency.order_levels(intervals).collect()}
    assert levels == {1: (5 / 3, 2), 2: (2.0, 2)}
    hour = kpis.kpis_by_hour(orders, intervals).collect()
    assert [(r["hour"], r["avg_ongoing_orders"], r["delivered"]) for r in hour] == [(10, 1.8, 2)]


@pytest.mark.parametrize("alone, shared, level", [(1, 1, 2), (3, 1, 1), (1, 3, 2)])
def test_level_rounds_half_to_even(spark, alone, shared, level):
    """One minute alone and one shared with one other order is a mean of 1.5."""
    end = 10 + alone + shared
    rows = [
        order(1, "06-01 10:10:00", f"06-01 10:{end:02d}:00"),
        order(2, f"06-01 10:{10 + alone:02d}:00", f"06-01 10:{end:02d}:00"),
    ]
    intervals = concurrency.ongoing_intervals(facts(spark, rows), CFG)
    found = {r[S.ORDER]: r for r in concurrency.order_levels(intervals).collect()}
    assert found[1]["mean_ongoing"] == (alone + 2 * shared) / (alone + shared)
    assert found[1][S.LEVEL] == level


def test_level_two_and_a_half_is_two(spark):
    rows = [order(1, "06-01 10:00:00", "06-01 10:02:00"), order(2, "06-01 10:00:00", "06-01 10:02:00")]
    rows.append(order(3, "06-01 10:01:00", "06-01 10:02:00"))
    intervals = concurrency.ongoing_intervals(facts(spark, rows), CFG)
    found = {r[S.ORDER]: (r["mean_ongoing"], r[S.LEVEL]) for r in concurrency.order_levels(intervals).collect()}
    assert found == {1: (2.5, 2), 2: (2.5, 2), 3: (3.0, 3)}


LEVEL_ROWS = [
    ("A", 1, 50, 10.0, 3.0),
    ("A", 2, 20, 16.0, 5.0),
    ("A", 3, 10, 14.0, 9.0),
    ("A", 4, 12, 18.0, 9.0),
    ("A", 5, 5, 20.0, 1.0),
    ("A", 6, 3, None, 2.0),
    ("B", 1, 5, 10.0, 1.0),
    ("B", 2, 5, 16.0, 2.0),
    ("C", 3, 7, 20.0, 1.0),
]


def test_thresholds_and_impacts(spark):
    table = thresholds.level_thresholds(level_table(spark, LEVEL_ROWS), CFG)
    window = {
        r[S.NAME]: (r["threshold_dispatch"], r["threshold_accept"], r["threshold_wtp"], r["threshold_prep_time"])
        for r in table.collect()
    }
    inf = -math.inf
    assert window == {"A": (4.0, inf, 4.0, 2.0), "B": (2.0, inf, None, 2.0), "C": (3.0, inf, 3.0, 3.0)}
    published = {
        (r[S.NAME], r["concept"].removeprefix("avg_min_")): (r["threshold"], r["lost_orders"], r["wtp_impact"])
        for r in thresholds.impacts(table).collect()
    }
    nothing = (None, None, None)
    assert published == {
        ("A", "dispatch"): (4.0, 8, 100.0),
        ("A", "accept"): (inf, 100, 1276.0),
        ("A", "wtp"): (4.0, 8, 100.0),
        ("A", "prep_time"): (2.0, 30, 456.0),
        ("B", "dispatch"): nothing,
        ("B", "accept"): (inf, 10, 130.0),
        ("B", "wtp"): nothing,
        ("B", "prep_time"): nothing,
        ("C", "dispatch"): nothing,
        ("C", "accept"): (inf, 7, 140.0),
        ("C", "wtp"): nothing,
        ("C", "prep_time"): nothing,
    }
    for suffix, concept in thresholds.THRESHOLD_KPIS.items():
        single = {(r[S.NAME], r[1 + 1], r[3], r[4]) for r in thresholds.impact(table, suffix).collect()}
        short = concept.removeprefix("avg_min_")
        assert single == {(n, *v) for (n, c), v in published.items() if c == short and v != nothing}


def _suggest(spark, threshold, lost, impact, orders, wtp):
    impacts = spark.createDataFrame(
        [(1, "A", "avg_min_wtp", threshold, lost, impact)],
        "store_address_id bigint, store_name string, concept string, threshold double, lost_orders bigint, wtp_impact double",
    )
    totals = spark.createDataFrame(
        [(1, orders, None if wtp is None else orders * wtp, wtp)],
        "store_address_id bigint, total_orders bigint, total_wtp double, avg_wtp double",
    )
    row = thresholds.store_suggestions(impacts, totals, CFG).collect()[0]
    return tuple(row)[2:]


@pytest.mark.parametrize(
    "given, want",
    [
        ((4.0, 8, 100.0, 100, 14.0), ("Follow-up", 4.0, 8.0, 0.08, 14.0, 14.0)),
        ((4.0, 10, 200.0, 100, 14.0), ("Critical", 4.0, 10.0, 0.1, 1200 / 90, 14.0)),
        ((4.0, 5, 100.0, 100, 14.0), ("Follow-up", 4.0, 5.0, 0.05, 1300 / 95, 14.0)),
        ((4.0, 0, 0.0, 100, 14.0), ("Decrease", 4.0, 0.0, 0.0, 14.0, 14.0)),
        ((None, None, None, 100, 7.5), ("Increase", None, None, None, None, 7.5)),
        ((None, None, None, 100, 7.6), ("Keep", 0.0, 0.0, 0.0, 0.0, 7.6)),
        ((2.0, 100, 900.0, 100, 14.0), ("Critical", 2.0, 100.0, 1.0, 14.0, 14.0)),
        ((2.0, 100, 1400.0, 100, 14.0), ("Critical", 2.0, 100.0, 1.0, None, 14.0)),
        ((2.0, 0, 0.0, 0, 14.0), ("Keep", 0.0, 0.0, 0.0, 0.0, 14.0)),
        ((None, None, None, 10, None), ("Keep", 0.0, 0.0, 0.0, 0.0, None)),
    ],
)
def test_suggestions(spark, given, want):
    assert _suggest(spark, *given) == want


@pytest.mark.parametrize(
    "points, want",
    [
        ([(2.0, 1), (4.0, 2), (6.0, 3)], 1.0),
        ([(2.0, 1)], 0.0),
        ([(0.1, 1), (0.1, 2), (0.1, 3)], None),
        ([(1.0, 2), (3.0, 3), (2.0, 9), (None, 4)], 0.01744186),
        ([(None, 1)], None),
        ([(1.0, 5), (2.0, 5)], 0.0),
    ],
)
def test_r_squared(spark, points, want):
    df = spark.createDataFrame(points, "y double, x int")
    value = df.agg(F.expr(r_squared("y", "x"))).collect()[0][0]
    assert value == (want if want is None else pytest.approx(want, abs=1e-8))


def test_compat_labels_repeat_the_waiting_time_fit(spark):
    table = level_table(spark, LEVEL_ROWS)
    own = statistics.kpi_r2(table, CFG).collect()[0]
    assert own["avg_min_accept"] is None and own["avg_min_prep_time"] is None
    same = statistics.kpi_r2(table, StudyConfig(compat_labels=True)).collect()[0]
    assert same["avg_min_accept"] == same["avg_min_wtp"] == same["avg_min_prep_time"] == own["avg_min_wtp"]


def test_level_ranges(spark):
    levels = spark.createDataFrame([(x,) for x in (1, 5, 6, 10, 45, 46, 50, 51, 400, 0)], "x int")
    got = [r[0] for r in levels.select(F.expr(level_range("x", CFG))).collect()]
    assert got == ["01--05", "01--05", "05--10", "05--10", "40--45", "45--50", "45--50", "50+", "50+", None]
    assert len(level_range_labels(CFG)) == 11
    assert level_range_labels(StudyConfig(range_width=10, range_cap=20)) == ["01--10", "10--20", "20+"]


def test_running_totals(spark):
    rows = [("A", 1, 10, 1.0, 1.0), ("A", 5, 20, 1.0, 1.0), ("A", 6, 50, 1.0, 1.0), ("A", 50, 20, 1.0, 1.0)]
    ranges = reports.kpis_by_level_range(level_table(spark, rows), CFG)
    got = reports.cumulative_by_range(ranges).orderBy("level_range").select("delivered", "accum", "perc").collect()
    assert [tuple(r) for r in got] == [(30, 30, 0.3), (50, 80, 0.8), (20, 100, 1.0)]


def test_range_means_keep_or_skip_unknown(spark):
    table = level_table(spark, [("A", 1, 1, 4.0, 2.0), ("A", 2, 1, None, 4.0)])
    table = table.withColumn("avg_min_dt", F.expr("CASE WHEN ongoing_orders = 1 THEN 30.0D END"))
    row = reports.kpis_by_level_range(table, CFG).collect()[0]
    assert (row["avg_min_wtp"], row["avg_min_dispatch"], row["avg_min_dt"]) == (None, 3.0, 30.0)


def test_strict_correlation_has_gaps(spark):
    table = level_table(spark, LEVEL_ROWS[:5])
    loose = {(r[0], r[1]): r[2] for r in statistics.level_kpi_correlation(table.fillna(1.0)).collect()}
    strict = {(r[0], r[1]): r[2] for r in statistics.level_kpi_correlation_strict(table).collect()}
    assert len(loose) == len(strict) == 49
    assert strict["ongoing_orders", "avg_min_accept"] is None
    assert strict["avg_min_accept", "avg_min_accept"] == 1.0
    assert strict["ongoing_orders", "delivered"] == pytest.approx(loose["delivered", "ongoing_orders"])
    assert loose["ongoing_orders", "avg_min_prep_time"] is None  # constant


def test_selection_ties_and_interpolation(spark):
    rows = [(s, n) for s, n in [(1, 4), (2, 4), (3, 1), (4, 2)]]
    counts = spark.createDataFrame(rows, "store_address_id bigint, orders bigint")
    kept = selection.stores_above_percentile(counts, 0.5)  # cutoff 3.0
    assert sorted(r[0] for r in kept.collect()) == [1, 2]
    assert [r[0] for r in selection.top_n_stores(kept, 1).collect()] == [1]


def test_parse_text_timestamps(spark):
    texts = ["2020-06-01 10:00:00", "2020-06-01 10:00:00.25", "", None, "soon", "2020-06-01", "2020-06-01 25:00:00"]
    log = spark.createDataFrame([(t,) for t in texts], "t string")
    full = log.selectExpr(*[f"t AS {c}" for c in S.LIFECYCLE])
    got = [r[0] for r in lifecycle.parse_lifecycle(full).collect()]
    assert got == [at("06-01 10:00:00"), at("06-01 10:00:00.25"), None, None, None, None, None]


@pytest.mark.parametrize(
    "text, clock",
    [
        ("2020/06/01 10:00:00", "06-01 10:00:00"),
        ("2020.06.01 10:00:00", "06-01 10:00:00"),
        ("20200601 10:00:00", "06-01 10:00:00"),
        ("20200601 100000", "06-01 10:00:00"),
        ("2020-6-1 9:05:07", "06-01 09:05:07"),
        (" 2020-06-01T10:00:00 ", "06-01 10:00:00"),
        ("2020-06-01 10:00:00 PM", "06-01 22:00:00"),
        ("2020-06-01 12:00:01 am", "06-01 00:00:01"),
        ("2020/06/01 12:30:00 PM", "06-01 12:30:00"),
        ("2020-06-01T10:00:00Z", "06-01 10:00:00"),
        ("2020-06-01T10:00:00-05:00", "06-01 15:00:00"),
        ("2020-06-01 03:00:00+0530", "05-31 21:30:00"),
        ("2020-06-01 10:00:00.25", "06-01 10:00:00.25"),
        ("2020-13-01 10:00:00", None),
        ("2020/06/01 10:61:00", None),
        ("2020-06-01 10:00", None),
        ("1:2:3", None),
    ],
)
def test_forms_of_timestamps(spark, text, clock):
    log = spark.createDataFrame([(text,)], "t string").selectExpr(*[f"t AS {c}" for c in S.LIFECYCLE])
    assert lifecycle.parse_lifecycle(log).collect()[0][0] == (at(clock) if clock else None)


def test_durations_keep_sign_and_fractions(spark):
    row = order(1, "06-01 10:00:00", "06-01 10:01:30.5", enters_pickup_local=at("06-01 10:05:00"))
    got = lifecycle.duration_minutes(lifecycle.duration_micros(log_of(spark, [row]))).collect()[0]
    assert got["min_dt"] == 90.5 / 60
    assert got["min_wtp"] == pytest.approx(-209.5 / 60)


def test_unescape(spark):
    cases = {
        r"plain": "plain",
        r"a\tb\nc": "a\tb\nc",
        r"back\\slash": "back\\slash",
        r"\x41\102\q": "ABq",
        r"\\n": r"\n",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(unescape(F.col("t"))).collect()] == list(cases.values())


@pytest.mark.parametrize("bad", [{"percentile": 1.5}, {"open_hour": 9, "close_hour": 9}, {"range_cap": 52}, {"top_n": 0}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        StudyConfig(**bad)
