from __future__ import annotations

import os
import re
from collections import Counter

import duckdb
import pytest
from conftest import SF_DIR
from helpers import COLUMNS, documents, messy_rows

import corpus_pipeline
from tidemark import staging
from tidemark.llm import queries
from tidemark.llm.shared import Stage


def test_one_query_for_each_operator():
    numbers = [int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert queries.ORACLES.keys() <= queries.QUERIES.keys()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries(spark, name):
    """Every query runs on whole tables, and equals its SQL where it has one."""
    found = queries.QUERIES[name](spark, SF_DIR).toArrow()
    assert found.num_rows > 0
    if name not in queries.ORACLES:
        return
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    sql = connection.execute(queries.ORACLES[name]).to_arrow_table()
    assert sorted(found.column_names) == sorted(sql.column_names)
    names = sorted(found.column_names)
    left, right = ([tuple(r[n] for n in names) for r in t.to_pylist()] for t in (found, sql))
    assert sorted(left, key=repr) == sorted(right, key=repr)


@pytest.fixture
def small_corpus(spark, tmp_path):
    """Messy documents, some of them toxic, with labels."""
    rows = [(i, t) for i, t in messy_rows() if i is not None]
    rows += [(1000 + i, f"plain words number {i} of many") for i in range(300)]
    rows += [(2000 + i, f"plain words vile{'x' * (i % 3)} number {i} of some") for i in range(60)]
    labels = [(1000 + i, 1, 0) for i in range(150)] + [(2000 + i, 0, 1) for i in range(40)]
    documents(spark, rows, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), rows


def test_stages_one_by_one(spark, small_corpus):
    from tidemark.llm import simhash
    from test_passages_and_lines import slow_removal

    folder, rows = small_corpus
    stage = Stage(spark)
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        docs = stage.table(apply(spark, docs, folder), name)
        kept[name] = docs
        if name != "best_fit_packing":
            assert docs.dtypes == before.dtypes
        if name == "toxicity":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            assert gone == {2000 + i for i in range(60)}
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "simhash_near_dedup":
            roots = simhash.simhash_components(before).select("root", "component_id").distinct()
            assert Counter(r.doc_id for r in docs.collect()) == Counter(r.component_id for r in roots.collect())
        if name == "substring_dedup":
            expected = slow_removal([(r.doc_id, r.text) for r in before.collect()], 50)
            got = [(r.doc_id, b" ".join((r.text or "").encode().split())) for r in docs.collect()]
            assert Counter(got) == Counter((e[0], e[3]) for e in expected)
    packed = kept["best_fit_packing"].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept["substring_dedup"].collect()}
    assert all(r.offset + r.length <= 2048 for r in packed)
    changed = [r for r in kept["line_dedup"].collect() if r.text is not None and r.n_chars != len(r.text)]
    assert not changed
    stage.drop()


def test_run_is_the_stages_in_order(spark, small_corpus):
    folder, _ = small_corpus
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert found.count() > 0


def test_stages_survive_messy_and_empty_tables(spark, small_corpus):
    folder, _ = small_corpus
    messy = documents(spark, messy_rows())
    empty = spark.createDataFrame([], COLUMNS)
    for name, apply in corpus_pipeline.STAGES:
        assert apply(spark, empty, folder).count() == 0
        found = apply(spark, messy, folder)
        if name != "best_fit_packing":
            assert found.columns == messy.columns
        assert found.count() > 0


def test_staged_tables_go(spark):
    stage = Stage(spark)
    stage.table(spark.range(3))
    folder = stage.root.removeprefix("file://")
    assert os.path.isdir(folder)
    stage.drop()
    assert not os.path.exists(folder)


def test_a_stage_frees_what_the_one_before_has_staged(spark, small_corpus, tmp_path, monkeypatch):
    """After each stage the shared folder holds its result and its own tables; after run(), the result alone."""
    folder, _ = small_corpus
    monkeypatch.setattr(staging, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, apply in corpus_pipeline.STAGES:
        apply(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        found.append(len(os.listdir(tmp_path / "shared")))
    assert found == [1] * 5
    result = corpus_pipeline.run(spark, folder)
    assert len(os.listdir(tmp_path / "shared")) == 2  # the packed pieces, and what the last stage reads
    assert result.count() > 0
