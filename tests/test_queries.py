"""Every registered query against its SQL on the smallest tables.

Queries on a study are built on one shared study per percentile, which also
checks that staged tables serve all of them; ``check_queries.py`` runs each
query on its own.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT, SF_DIR

import __spark_entry__ as entry
import oracle_queries
from check_queries import connect, _plain, rows_of
from tidemark import Study, StudyConfig


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.fixture(scope="module", params=[0.95, 0.5])
def study(request, spark):
    made = Study(entry._log(spark, SF_DIR), StudyConfig(percentile=request.param))
    made.share("by_level", "store_kpis")
    yield made
    made.close()


def same(ours, connection, sql):
    connection.sql(sql).create_view("expected", replace=True)  # every statement can be one
    ours, theirs = ours.toArrow(), connection.sql("SELECT * FROM expected").to_arrow_table()
    left = {f.name: _plain(f.type) for f in ours.schema}
    assert left == {f.name: _plain(f.type) for f in theirs.schema}
    assert rows_of(ours, sorted(left)) == rows_of(theirs, sorted(left))


@pytest.mark.parametrize("name", sorted(entry._log_queries()))
def test_log_query(spark, connection, name):
    same(entry._log_queries()[name](spark, SF_DIR), connection, oracle_queries.selection_sql(0.95)[name])


@pytest.mark.parametrize("name", sorted(entry._study_tables()))
def test_study_query(study, connection, name):
    ours = entry._published(name, entry._study_tables()[name](study))
    same(ours, connection, oracle_queries.study_sql(study.cfg.percentile)[name])


def test_every_query_has_sql():
    """Those of the subpackage for training data, where it is installed, may have none."""
    own = entry.queries().keys() - entry._training_data()[0].keys()
    assert own == entry.oracle_sql().keys() - entry._training_data()[1].keys()


@pytest.mark.parametrize("name", entry.NAMED_QUERIES)
def test_named_query(spark, connection, name):
    found = entry.queries()[f"{name}_named"](spark, SF_DIR)
    assert found.count() > 0
    same(found, connection, entry.oracle_sql()[f"{name}_named"])


def test_whole_numbers_are_published_whole(spark):
    values = [16_777_217.0, 2.0**40 + 1, -3.0, 0.5, None, float("-inf")]
    table = spark.createDataFrame([(v,) for v in values], "value double")
    assert [r[0] for r in entry._publish(table).collect()] == values


def test_entry_without_the_training_subpackage(tmp_path):
    """The rest imports and lists its queries without it."""
    for source in ["tidemark", "__spark_entry__.py", "oracle_queries.py"]:
        place = os.path.join(ROOT, source)
        if os.path.isdir(place):
            shutil.copytree(place, tmp_path / source, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(place, tmp_path / source)
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert told.stdout.split()[0] == str(len(entry.queries()) - len(entry._training_data()[0]))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
