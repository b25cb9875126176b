from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF_DIR
from helpers import COLUMNS, documents, messy_rows
from pyspark.sql import functions as F

from tidemark.llm import negatives, periodic, queries, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
NAN, INF = float("nan"), float("inf")

# --- token counts -------------------------------------------------------------------

PARTS = ["a", "the ", "ing", "  ", " ", "\n\n\n", "é", "日本", "<s>", "</s>", "▁", "<unk>", "<0x0A>", "x" * 30, "a" * 50]
PARTS += ["😀", "\x00", "\t", "", " " * 20, "ab", "1", "22", "ﬁ", "́", "　", "﻿"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("chunk, overlap, span", [(8, 1, 30), (40, 5, 100), (3, 2, 1)])
def test_spliced_counts(model, monkeypatch, chunk, overlap, span):
    for name, value in (("CHUNK", chunk), ("OVERLAP", overlap), ("SPAN", span)):
        monkeypatch.setattr(token_counts, name, value)
    counter, rng = token_counts.Counter(MODEL), random.Random(chunk)
    assert counter.spliceable
    for _ in range(700):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(60)))
        whole = len(model.encode(text))
        assert counter.count(text) == whole, text
        assert sum(counter.count(part, lead) for lead, part in counter.spans(text)) == whole, text


def test_overlaps_widen_where_no_border_is_proven(model, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 64)
    monkeypatch.setattr(token_counts, "OVERLAP", 8)
    counter = token_counts.Counter(MODEL)
    text = "start " + "a" * 3000 + " end"
    assert len(counter.proven_borders(text, 10, 2900)) == 0
    calls = []
    encode = counter._encode
    monkeypatch.setattr(counter, "_encode", lambda *a: calls.append(a[1:]) or encode(*a))
    assert counter.count(text) == len(model.encode(text))
    assert max(end - begin for begin, end in calls) >= 2900  # the left chunk has grown over the run
    assert len(calls) < 40


def test_a_model_that_rewrites_texts_is_asked_for_whole_texts(model, monkeypatch):
    counter = token_counts.Counter(MODEL)
    counter.spliceable = False
    text = "some words " * 3000
    assert counter.count(text) == len(model.encode(text))
    monkeypatch.setattr(token_counts, "SPAN", 100)
    assert [len(part) for _, part in counter.spans(text)] == [len(text)]


def test_count_tokens(spark, model):
    rng = random.Random(3)
    long = [" ".join(rng.choice(["word", "thorough", "né", "x,", "日本語", "\n"]) for _ in range(60_000)) for _ in range(2)]
    rows = messy_rows() + [(900, long[0]), (901, long[1]), (902, long[0]), (902, long[0]), (None, long[1])]
    rows += [(903, "b" * 200_000), (904, "日" * 70_000)]
    found = token_counts.count_tokens(documents(spark, rows), MODEL)
    assert found.columns == ["id", "n_bytes", "n_tokens"]
    expected = Counter((i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert Counter(map(tuple, found.collect())) == expected
    assert token_counts.count_tokens(spark.createDataFrame([], COLUMNS), MODEL).count() == 0


def test_token_count_query(spark, model):
    found = {tuple(r) for r in queries.op11_token_counts(spark, SF_DIR).collect()}
    texts = queries.read(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    counts = {r.doc_id: len(model.encode(r.text or "")) for r in texts}
    assert found == {(r.doc_id, len((r.text or "").encode()), counts[r.doc_id], counts[r.doc_id] > 4096) for r in texts}


# --- periodic runs ------------------------------------------------------------------


def slow_runs(words, least):
    """For each period the stretches in which words a period apart are identical."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        start = 0
        for j in range(len(words) - p + 1):
            if j == len(words) - p or words[j] != words[j + p]:
                if j - start >= p and j - start + p >= least:
                    found.setdefault((start, j + p), p)
                start = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def planted(rng, n, letters):
    words = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randrange(3) if n else 0):
        a = rng.randrange(n)
        p = 1 + rng.randrange(max(1, (n - a) // 3))
        b = rng.randrange(a, n + 1)
        words = [words[a + (i - a) % p] if a <= i < b else w for i, w in enumerate(words)]
    return words


@pytest.mark.parametrize("least, at_once", [(12, 1 << 19), (2, 1 << 19), (5, 7)])
def test_runs_of_many_texts(monkeypatch, least, at_once):
    monkeypatch.setattr(periodic, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(least)
    for _ in range(400):
        texts = [planted(rng, rng.choice([0, 1, 2, 11, 12, 13, 40, 150]), rng.choice([1, 2, 3, 60])) for _ in range(rng.randrange(6))]
        text, *spans = periodic.find_runs([np.array(t, np.int64) for t in texts], least)
        found = [[] for _ in texts]
        for i, *run in zip(text.tolist(), *(c.tolist() for c in spans)):
            found[i].append(tuple(run))
        assert [sorted(f) for f in found] == [slow_runs(t, least) for t in texts], texts


def test_grammar_compares_any_two_places():
    rng = random.Random(1)
    for n, letters in [(1, 1), (2, 1), (60, 1), (80, 2), (200, 3), (300, 100)]:
        words = np.array([-1, *planted(rng, n, letters), -2])
        x, y = np.array([(i, j) for i in range(1, n + 1) for j in range(i + 1, n + 1)] or [(0, 1)]).T
        grammar = periodic.Grammar(words)
        ahead, back = grammar.extend(x, y, True), grammar.extend(x, y, False)
        for i, j, f, b in zip(x.tolist(), y.tolist(), ahead.tolist(), back.tolist()):
            assert f == next(k for k in range(n + 2) if words[i + k] != words[j + k])
            assert b == next(k for k in range(n + 2) if words[i - k] != words[j - k])


def test_grammar_is_logarithmic_and_compares_in_few_steps():
    rng = np.random.default_rng(4)
    words = np.concatenate([[-1], np.tile(rng.integers(0, 5, 3000), 30), [-2]])
    grammar = periodic.Grammar(words)
    assert len(grammar.levels) < 80
    steps = []
    plain = grammar._stepped
    grammar._stepped = lambda *a: steps.append(len(a[1])) or plain(*a)
    ahead = grammar.extend(np.array([1]), np.array([3001]), True)
    assert ahead.tolist() == [len(words) - 3002]
    assert sum(steps) < 4 * len(grammar.levels)


def slow_row(doc_id, words, least=12):
    runs = slow_runs(words, least)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return [w.decode() for w in (text or "").encode().split()]


def test_periodic_runs(spark):
    rng = random.Random(8)
    rows = messy_rows() + [(500 + k, " \n".join(f"w{x}" for x in planted(rng, 150, 4))) for k in range(30)]
    rows += [(600, "a " * 40_000), (601, "x y z " * 9000 + "end"), (None, "q " * 15), (602, " ".join(map(str, range(70_000))))]
    docs = documents(spark, rows).withColumns({c: F.lit(5) for c in ("runs", "collapsed", "n_words")})
    found = periodic.periodic_runs(docs).collect()
    got = Counter((r.row.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found)
    expected = Counter()
    for i, text in rows:
        words = words_of(text)
        if i == 602:
            runs, kept = [], " ".join(words)
        elif i in (600, 601):  # one run of all repeating words
            p = 1 if i == 600 else 2
            runs, kept = [(0, len(words) - (i == 601), p)], " ".join(words[:p] + (["end"] if i == 601 else []))
        else:
            runs, kept = slow_row(i, words)
        expected[(i, len(words), tuple(sorted(runs, key=lambda r: (r[0], r[2]))), kept)] += 1
    assert got == expected
    assert found[0].row.asDict().keys() == set(docs.columns)
    assert periodic.periodic_runs(spark.createDataFrame([], COLUMNS)).count() == 0


def check_run_rows(found, rows):
    expected = Counter()
    for i, text in rows:
        words = words_of(text)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs, kept = slow_row(i, words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept))
        expected[(i, len(runs), *best, best[1] and 1000 * best[1] // best[2], *digests)] += 1
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert found.columns == list(names)
    assert Counter(map(tuple, found.collect())) == expected
    return expected


def test_periodic_run_query(spark, tmp_path):
    docs = queries.read(spark, SF_DIR, "documents").select("doc_id", "text").collect()
    found = check_run_rows(queries.op12_periodic_runs(spark, SF_DIR), docs)
    assert sum(row[1] > 0 for row in found) > 5
    rng = random.Random(2)
    rows = messy_rows() + [(1000 + k, " ".join(str(x) for x in planted(rng, 60, 5))) for k in range(80)]
    documents(spark, rows, clashing=False).write.parquet(f"{tmp_path}/documents.parquet")
    check_run_rows(queries.op12_periodic_runs(spark, str(tmp_path)), rows)


# --- hard negatives -----------------------------------------------------------------


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


def slow_negatives(rows, positives, hard, least, most, scale=256):
    usable = [
        (i, label, tuple(max(-(2**63), min(2**63 - 1, math.floor(scale * x) if abs(scale * x) < INF else int(math.copysign(2**63, x)))) for x in v), v)
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for anchor in {r[0] for r in usable if r[0] % 3 == 0}:
        _, label, own, _ = min((r for r in usable if r[0] == anchor), key=lambda r: (r[3], r[1]))
        scored = [
            (-wrapped(sum(a * b for a, b in zip(own, v))), i, other)
            for i, other, v, _ in usable
            if i != anchor and len(v) == len(own)
        ]
        scored.sort()
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p][:hard]
            for rank, (s, i, _) in enumerate(fit, 1):
                out[(anchor, positive, rank, i, -p, -s)] += 1
    return out


def labelled(seed=3, dim=11, n=120):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(dim)], rng.randrange(3)) for i in range(n)]
    rows += [(200 + i, rows[4][1], i % 2) for i in range(25)]  # ties
    rows += [(300, None, 1), (303, [NAN] * dim, 1), (306, [INF] * dim, 1), (309, [0.5] * (dim - 1) + [None], 1)]
    rows += [(312, [0.5] * dim, None), (None, [0.5] * dim, 1), (315, [], 1), (316, [], 2), (318, [0.25, 0.5], 0)]
    rows += [(319, [1.0, 0.5], 0), (320, [0.5, 0.25], 1), (321, [0.3, 0.1], 7), rows[0], (3, [0.0] * dim, 2)]
    rows += [(7, rows[8][1], 1), (400, [0.0] * dim, 1), (402, [0.0] * dim, 1), (403, [-0.1] * dim, 9)]
    return rows


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    clashing = ["id", "vector", "limits", "slot", "part", "planes", "score", "rank", "own", "anchor_id"]
    return df.selectExpr("*", *[f"'x' AS {c}" for c in clashing])


@pytest.mark.parametrize("positives, hard, least, most", [(5, 10, 30, 90), (1, 3, 0, 100), (40, 400, 30, 90)])
def test_hard_negatives_equal_brute_force(spark, positives, hard, least, most):
    rows = labelled()
    found = negatives.hard_negatives(
        vectors(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"), positives, hard, (least, 100), (most, 100)
    )
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found.columns == names
    expected = slow_negatives(rows, positives, hard, least, most)
    assert expected and Counter(map(tuple, found.collect())) == expected


def test_components_of_any_size(spark):
    rng = random.Random(5)
    sizes = [1e-310, 1.0, 1e6, 3e9, 1e17, 1e306, -1e306]
    rows = [(i, [rng.choice(sizes) * rng.uniform(0.5, 1) for _ in range(3)], i % 2) for i in range(60)]
    found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"))
    assert Counter(map(tuple, found.collect())) == slow_negatives(rows, 5, 10, 30, 90)


@pytest.mark.parametrize("largest", [0, 1, 127, 128, 10**6, 2**40, 2**62])
def test_looked_up_scores(largest):
    rng = np.random.default_rng(largest % 97)
    for dim in (0, 1, 8, 13):
        a, v = (rng.integers(-largest - 1, largest + 1, (n, dim)) for n in (5, 40))
        tables = negatives.subset_sums(a)
        assert tables.shape == (-(-dim // 8), 256, 5)
        expected = [[wrapped(sum(int(x) * int(y) for x, y in zip(p, q))) for p in a] for q in v]
        assert negatives.scores(tables, negatives.bit_planes(v)).reshape(40, 5).tolist() == expected


def test_best_rows_are_merged_chunk_by_chunk():
    rng = np.random.default_rng(1)
    scored, ids = rng.integers(-4, 5, (300, 6)), rng.permutation(300).astype(np.int64)
    allowed = rng.random((300, 6)) < 0.7
    best = negatives._Best(6, 4)
    for at in range(0, 300, 37):
        best.add(np.arange(6), ids[at : at + 37], scored[at : at + 37], allowed[at : at + 37].copy())
    found = list(zip(*(x.tolist() for x in best.rows())))
    for c in range(6):
        own = sorted((-int(s), int(i)) for s, i, a in zip(scored[:, c], ids, allowed[:, c]) if a)[:4]
        assert [(i, s) for slot, i, s in found if slot == c] == [(i, -s) for s, i in own]


def test_no_rows(spark):
    for rows in ([], [(1, [1.0], 1)], [(3, [1.0], 1)], [(3, [1.0], 1), (4, [1.0], 2)], [(3, [1.0], 1), (4, [1.0], 1)]):
        found = negatives.hard_negatives(vectors(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"))
        assert found.count() == 0
