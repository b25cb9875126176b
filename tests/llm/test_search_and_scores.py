from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import documents, messy_rows
from pyspark.sql import functions as F

from tidemark.llm import topk, toxicity

NAN, INF = float("nan"), float("inf")


def slow_top(rows, k):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in usable]
    queries = {}
    for (i, v), (_, raw) in zip(whole, usable):
        if i % 3 == 0 and (i not in queries or raw < queries[i][1]):
            queries[i] = (v, raw)
    out = Counter()
    for q, (v, _) in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        for rank, (s, i) in enumerate(scored[:k], 1):
            out[(q, rank, i, -s)] += 1
    return out


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    return df.selectExpr("*", "'x' AS id", "1 AS vector", "2 AS rank", "3 AS tile", "4 AS score")


def messy_vectors(dim=6, n=90, seed=3):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(200 + i, rows[4][1]) for i in range(25)]  # ties
    rows += [(300, None), (301, [0.1] * 5 + [None]), (303, [NAN] * dim), (306, [INF] + [0.0] * 5), (None, [0.5] * dim)]
    rows += [(309, [0.25, 0.5]), (310, [1.0, -1.0]), (312, []), (313, [])]
    rows += [rows[0], (3, [0.0] * dim), (7, rows[8][1]), (400, [0.0] * dim), (402, [-0.0] * dim)]
    return rows


@pytest.mark.parametrize("tile_bytes, at_once", [(2 << 20, 1 << 21), (300, 40)])
def test_top_k_equals_brute_force(spark, monkeypatch, tile_bytes, at_once):
    monkeypatch.setattr(topk, "TILE_BYTES", tile_bytes)
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", at_once)
    rows = messy_vectors()
    for k in (1, 10, 500):
        found = topk.top_k(vectors(spark, rows), F.col("vec_id") % 3 == 0, k=k).collect()
        assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == slow_top(rows, k)


def test_small_tiles_in_one_task(monkeypatch):
    """Partial selection and merging, called as the tasks call it."""
    monkeypatch.setattr(topk, "SCORES_AT_ONCE", 64)
    rng = np.random.default_rng(1)
    queries, data = rng.integers(-3, 4, (8, 3)).astype(float), rng.integers(-3, 4, (60, 3)).astype(float)
    import pyarrow as pa

    rows = [
        {
            "tile": 0,
            "dim": 3,
            "ids": np.arange(a, a + 20, dtype="<i8").tobytes(),
            "vectors": data[a : a + 20].astype("<f8").tobytes(),
            "query_ids": np.arange(8, dtype="<i8").tobytes(),
            "queries": queries.astype("<f8").tobytes(),
        }
        for a in (0, 20, 40)
    ]
    batches = [pa.RecordBatch.from_pylist([r]) for r in rows]
    found = [x for b in topk._search(4)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns))]
    for q in range(8):
        scored = sorted((-int(queries[q] @ data[i]), i) for i in range(60) if i != q)[:4]
        assert sorted((-s, i) for name, i, s in found if name == q) == sorted(scored)


def test_products_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    other = np.array([[2.0**20, 3.0], [2.0**23, 1.0]])
    assert topk._products(big, other).tolist() == [[2**60 + 3, -(2**63) + 1]]


def test_components_that_are_no_longs(spark):
    rng = random.Random(4)
    sizes = [1e-3, 1.0, 1e9, 1e17, 1e306, -1e306, 1.7e308]
    rows = [(i, [rng.choice(sizes) * rng.uniform(0.5, 1) for _ in range(3)]) for i in range(40)]

    def whole(x):
        return 2**63 - 1024 if x > 2**53 and 1024 * x >= 2.0**63 else -(2**63) if 1024 * x < -(2.0**63) else math.floor(1024 * x)

    expected = Counter()
    for q, v in rows:
        if q % 3 == 0:
            scored = []
            for i, w in rows:
                score = sum(whole(a) * whole(b) for a, b in zip(v, w))
                scored.append((-((score + 2**63) % 2**64 - 2**63), i))
            for rank, (s, i) in enumerate(sorted(x for x in scored if x[1] != q)[:5], 1):
                expected[(q, rank, i, -s)] += 1
    found = topk.top_k(vectors(spark, rows), F.col("vec_id") % 3 == 0, k=5).collect()
    assert Counter((r.query_id, r.rank, r.vec_id, r.score) for r in found) == expected


def test_no_vectors(spark):
    empty = vectors(spark, [])
    assert topk.top_k(empty, F.col("vec_id") % 3 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 3 == 0).count() == 0
    assert topk.top_k(vectors(spark, [(3, [1.0])]), F.col("vec_id") % 3 == 0).count() == 0


# --- toxicity ----------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    classifier = toxicity.train(docs, labels)
    scored = toxicity.scores(docs, classifier).select("row.doc_id", "score")
    rows = scored.where(toxicity.held_out("doc_id")).join(labels, "doc_id").collect()
    hit = sum(r.score >= 0.5 and r.toxic == 1 for r in rows)
    assert hit / sum(r.toxic == 1 for r in rows) > 0.85
    assert hit / sum(r.score >= 0.5 for r in rows) > 0.75


def test_held_out_rows_teach_nothing(spark):
    import zlib

    ids = [i for i in range(4000)]
    out = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0][:200]
    rest = [i for i in ids if zlib.crc32(str(i).encode()) % 5][:400]
    rows = [(i, "plain words vile" if i in out else "plain words") for i in [*out, *rest]]
    marked = spark.createDataFrame([(i, 1) for i in out] + [(i, 0) for i in rest], "doc_id bigint, toxic int")
    assert toxicity.train(documents(spark, rows), marked).weights == {}


def test_very_long_and_empty_texts_are_scored(spark):
    classifier = toxicity.Classifier({"vile": 3.0}, -1.0)
    rows = [(1, "plain " * 400_000 + "vile"), (2, "x" * 2_000_000), (3, ""), (4, None)]
    found = {r.row.doc_id: round(r.score, 6) for r in toxicity.scores(documents(spark, rows), classifier).collect()}
    assert found == {1: round(1 / (1 + math.exp(-2)), 6), **{i: round(1 / (1 + math.e), 6) for i in (2, 3, 4)}}


def test_learning_from_positive_and_unlabelled():
    rng = np.random.default_rng(2)

    def texts(n, share):
        toxic = rng.random(n) < share
        rows = [np.unique(np.r_[rng.integers(5, 60, 12), rng.integers(0, 5, 2) if t else []]).astype(int) for t in toxic]
        return rows, toxic

    positive, _ = texts(150, 1.0)
    unlabelled, kind = texts(1500, 0.15)
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 60, 0.15, toxicity.Training())
    guess = np.array([weights[r].sum() + bias > 0 for r in unlabelled])
    assert (guess == kind).mean() > 0.97


def test_scores_of_messy_rows(spark):
    rows = messy_rows()
    docs = documents(spark, rows)
    classifier = toxicity.Classifier({"w1": 2.0, "w2-": 1.0}, -1.0)
    found = toxicity.scores(docs, classifier)
    assert found.select("row.*").columns == docs.columns
    got = Counter((r.row.doc_id, round(r.score, 9)) for r in found.collect())
    expected = Counter()
    for i, t in rows:
        have = {f for w in toxicity.words_of(t) for f in toxicity.features_of(w)}
        s = -1 + 2 * ("w1" in have) + ("w2-" in have)
        expected[(i, round(1 / (1 + math.exp(-s)), 9))] += 1
    assert got == expected


def test_nothing_to_learn_from(spark):
    docs = documents(spark, messy_rows())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    clean = spark.createDataFrame([(1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    absent = spark.createDataFrame([(99_999, 1), (99_998, 1), (1, 0)], "doc_id bigint, toxic int")
    for labels in (none, clean, absent):
        classifier = toxicity.train(docs, labels)
        assert classifier.weights == {}
    assert toxicity.scores(docs, classifier).where("score >= 0.5").count() == 0
    empty = documents(spark, [])
    assert toxicity.scores(empty, toxicity.train(empty, absent)).count() == 0
