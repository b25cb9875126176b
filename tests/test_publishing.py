"""Reports as a set, and into tables that are there already."""

from __future__ import annotations

import os

import pytest
from builders import log_of, order
from conftest import SF_DIR

import __spark_entry__ as entry
from tidemark import Study, StudyConfig
from tidemark.plans import study as plans
from tidemark.sinks import publishing
from tidemark.sinks.publishing import ReportFolder, ReportViews
from tidemark.sinks.tables import REPORT_NAMES, overwrite_rows, write_report

CFG = StudyConfig(percentile=0.5)


class Killed(Exception):
    pass


def kill_at(monkeypatch, nth):
    """The writer dies within report number ``nth``, after some of its files are there."""
    calls = []

    def write(report, path=None, table=None, fmt="parquet"):
        calls.append(path or table)
        write_report(report, path, table, fmt)
        if len(calls) == nth:
            raise Killed

    monkeypatch.setattr(publishing, "write_report", write)


def shown(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def study(spark):
    with Study(entry._log(spark, SF_DIR), CFG) as made:
        yield made


@pytest.fixture(scope="module")
def later(spark):
    """Another month: some of the stores."""
    with Study(entry._log(spark, SF_DIR).where("store_address_id < 10"), CFG) as made:
        yield made


def test_a_folder_is_replaced_as_a_whole(spark, study, later, tmp_path, monkeypatch):
    place = ReportFolder(spark, f"file://{tmp_path}/reports/")
    assert place.current() is None and place.versions() == []
    with pytest.raises(FileNotFoundError):
        place.read("InfoHour")
    written = study.publish_reports(place.folder)
    assert [os.path.basename(p) for p in written] == list(REPORT_NAMES.values())
    old = {name: shown(place.read(name)) for name in REPORT_NAMES.values()}
    assert old["InfoHour"] == shown(study.report_hour) != []
    reading = place.read("Impacts")

    kill_at(monkeypatch, 3)
    with pytest.raises(Killed):
        later.publish_reports(place.folder)
    assert {name: shown(place.read(name)) for name in REPORT_NAMES.values()} == old
    assert place.versions() == [place.current()["version"]]
    monkeypatch.undo()

    later.publish_reports(place.folder, fmt="json")
    assert place.current()["format"] == "json" and len(place.versions()) == 2
    assert len(shown(place.read("InfoGroup"))) == later.report_level_range.count() != len(old["InfoGroup"])
    assert shown(reading) == old["Impacts"]  # who began to read the old set can go on

    later.publish_reports(place.folder, keep=0)
    assert place.versions() == [place.current()["version"]]
    assert sorted(f for f in os.listdir(tmp_path / "reports") if not f.endswith(".crc")) == ["current", "versions"]


def test_views_are_switched_last(spark, study, later, tmp_path, monkeypatch):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS set_test LOCATION '{tmp_path}/db'")
    try:
        names = study.publish_reports(tables="set_test.june_")
        assert names == [f"set_test.june_{n}" for n in REPORT_NAMES.values()]
        old = {name: shown(spark.table(name)) for name in names}
        assert all(old.values())
        views = ReportViews(spark, "set_test.june_")
        first = {views.current(n) for n in REPORT_NAMES.values()}
        assert len(first) == 1

        kill_at(monkeypatch, 3)
        with pytest.raises(Killed):
            later.publish_reports(tables="set_test.june_")
        assert {name: shown(spark.table(name)) for name in names} == old
        monkeypatch.undo()

        show = ReportViews._show  # the third view can't be switched

        def fail(self, report, version):
            if report == "InfoGroup" and version not in first:
                raise Killed
            show(self, report, version)

        monkeypatch.setattr(ReportViews, "_show", fail)
        with pytest.raises(Killed):
            later.publish_reports(tables="set_test.june_")
        assert {name: shown(spark.table(name)) for name in names} == old
        assert spark.sql("SHOW TABLES IN set_test").count() == 8  # four tables and their views
        monkeypatch.undo()

        later.publish_reports(tables="set_test.june_", keep=0)
        assert shown(spark.table("set_test.june_InfoGroup")) == shown(later.report_level_range) != old[names[2]]
        assert spark.sql("SHOW TABLES IN set_test").count() == 8
        with pytest.raises(ValueError, match="is a view"):
            later.write_reports(tables="set_test.june_", only=["Impacts"])
        study.write_reports(tables="set_test.plain_", only=["Impacts"])
        with pytest.raises(ValueError, match="is a table"):
            study.publish_reports(tables="set_test.plain_")
    finally:
        spark.sql("DROP DATABASE set_test CASCADE")


def test_a_study_can_publish_again_after_a_failure(spark, study, tmp_path, monkeypatch):
    place = ReportFolder(spark, str(tmp_path / "again"))

    def fail(*_, **__):
        raise Killed

    for broken in (1, 2):  # the second report is watched, and never written
        done = []
        monkeypatch.setattr(publishing, "write_report", lambda *a, **k: fail() if len(done) == broken else done.append(write_report(*a, **k)))
        with pytest.raises(Killed):
            study.publish_reports(place.folder)
    monkeypatch.undo()
    study.publish_reports(place.folder)
    assert place.read("InfoOO").count() == study.report_level.count()


def test_a_set_needs_one_place(study):
    for wrong in ({}, {"folder": "x", "tables": "y"}):
        with pytest.raises(ValueError):
            study.publish_reports(**wrong)


def test_command_line_publishes_a_set(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    entry._log(spark, SF_DIR).write.parquet(str(tmp_path / "log"))
    for _ in range(2):
        main(["--log", f"{tmp_path}/log", "--log-format", "parquet", "--out", f"{tmp_path}/out", "--as-set"])
    assert len(capsys.readouterr().out.split()) == 8
    assert ReportFolder(spark, str(tmp_path / "out")).read("Impacts").count() > 0


def test_a_table_keeps_what_it_is(spark, study, later, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS kept_test LOCATION '{tmp_path}/db'")
    try:
        study.write_reports(tables="kept_test.r_", only=["Impacts"])
        table = "kept_test.r_Impacts"
        spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('team' = 'sales')")
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN suggestion COMMENT 'what to do'")
        later.write_reports(tables="kept_test.r_", only=["Impacts"])
        assert shown(spark.table(table)) == shown(later.store_suggestions) != shown(study.store_suggestions)
        properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {table}").collect()}
        assert properties["team"] == "sales"
        comments = {c.name: c.description for c in spark.catalog.listColumns(table)}
        assert comments["suggestion"] == "what to do"

        report = later.store_suggestions
        for wrong in (report.drop("perc_lost"), report.selectExpr("*", "1 AS more"), report.withColumn("real_wtp", report.store_name)):
            with pytest.raises(ValueError, match="perc_lost|more|real_wtp"):
                overwrite_rows(wrong, table)
        assert shown(spark.table(table)) == shown(report)
        columns = report.columns
        overwrite_rows(report.select(columns[::-1]), table)  # matched by name
        assert shown(spark.table(table)) == shown(report)
    finally:
        spark.sql("DROP DATABASE kept_test CASCADE")


def test_levels_of_a_table_may_change(spark, tmp_path):
    def study_of(*sizes):
        rows = [
            order(100 * n + i, "06-01 10:00:00", "06-01 10:05:00", store=n)
            for n, size in enumerate(sizes)
            for i in range(size)
        ]
        return Study(log_of(spark, rows), StudyConfig(percentile=0.0))

    spark.sql(f"CREATE DATABASE IF NOT EXISTS levels_test LOCATION '{tmp_path}/db'")
    try:
        for sizes, header, cells in [
            ((2, 5), ["2", "5"], {(0, 2.0, None), (1, None, 5.0)}),
            ((3, 5), ["2", "5", "3"], {(0, None, None, 3.0), (1, None, 5.0, None)}),
            ((2,), ["2", "5", "3"], {(0, 2.0, None, None)}),
        ]:
            with study_of(*sizes) as study:
                study.write_reports(tables="levels_test.r_", only=["InfoOO"])
            found = spark.table("levels_test.r_InfoOO")
            assert found.columns == ["store_address_id", "store_name", "concept", "r2", "value", *header]
            delivered = found.where("concept = 'delivered'").select("store_address_id", *header)
            assert {tuple(r) for r in delivered.collect()} == cells
    finally:
        spark.sql("DROP DATABASE levels_test CASCADE")


def test_names_of_reports_are_those_of_a_study():
    assert all(hasattr(plans.Study, name) for name in REPORT_NAMES)
