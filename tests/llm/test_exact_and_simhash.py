from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import documents, edited, groups, messy_rows, sentence

from tidemark.llm import exact, hamming, simhash
from tidemark.llm.shared import Stage, components, signed


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("digest", [False, True])
def test_exact_groups_equal_brute_force(spark, digest):
    rows = messy_rows()
    found = exact.exact_duplicates(documents(spark, rows), prefix_chars=5, digest=digest).collect()
    by_text = {}
    for i, t in rows:
        by_text.setdefault(normal(t), []).append(i)
    expected = Counter()
    for text, ids in by_text.items():
        keep = min((i for i in ids if i is not None), default=None)
        taken = False
        for i in ids:
            kept = i == keep and not taken
            taken |= kept
            whole = hashlib.sha256(text.encode()).hexdigest() if digest or len(ids) > 1 else None
            expected[(i, keep if len(ids) > 1 else i, len(ids), kept, whole)] += 1
    got = Counter((r.id, r.keep_id, r.group_size, r.kept, r.full_hash) for r in found)
    # a hash of a text that is alone may be told where its length and beginning are shared
    if not digest:
        got = Counter({(*k[:4], k[4] if k[2] > 1 else None): 0 for k in got}) + Counter(
            (r.id, r.keep_id, r.group_size, r.kept, r.full_hash if r.group_size > 1 else None) for r in found
        )
    assert got == expected


def test_exact_runs_no_python(spark):
    plan = exact.exact_duplicates(documents(spark, messy_rows(), clashing=False))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert exact.exact_duplicates(empty, digest=True).count() == 0
    found = simhash.simhash_components(empty)
    assert found.count() == 0
    assert simhash.one_of_each(empty, found).count() == 0


# --- fingerprints ------------------------------------------------------------


def slow_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_definition(monkeypatch):
    rng = random.Random(1)
    texts = [t for _, t in messy_rows()] + [sentence(rng, n) for n in (1, 2, 3, 4, 254, 255, 256, 257, 258, 800)]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_fingerprint_hash_is_that_of_the_sql_function(spark):
    value = spark.sql("SELECT xxhash64('één tWo three')").first()[0]
    assert simhash.fingerprint("één two three") == simhash.fingerprint("één tWo three")
    assert signed(xxhash.xxh64_intdigest("één tWo three".encode(), 42)) == value


def test_components_equal_brute_force(spark):
    rows = messy_rows()
    found = simhash.simhash_components(documents(spark, rows)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    near = [(a, b) for a, b in itertools.combinations(set(prints), 2) if (a ^ b).bit_count() <= 3]
    root = groups(near, set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    expected = Counter((i, signed(p), least.get(root[p])) for (i, _), p in zip(rows, prints))
    assert Counter((r.id, r.fp, r.component_id) for r in found) == expected
    assert any(n > 5 for n in Counter(r.component_id for r in found).values())


def test_one_of_each_component(spark):
    rows = messy_rows()
    docs = documents(spark, rows)
    found = simhash.simhash_components(docs)
    kept = simhash.one_of_each(docs, found)
    assert kept.columns == docs.columns
    expected = {(r.root, r.component_id) for r in found.collect()}
    got = Counter((r.root, r.component_id) for r in simhash.simhash_components(kept).collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least for _, least in expected)
    assert len(got) == len(expected) == kept.count()


# --- links ---------------------------------------------------------------------


def near_cluster(rng, n, flips):
    center = rng.getrandbits(64)
    return {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(flips + 1))) for _ in range(n)}


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_ring_masks_and_chain_lose_no_pair(distance):
    rng = random.Random(distance)
    test, masks = simhash.chain_test(distance), simhash.ring_masks(distance)
    for _ in range(3000):
        x = rng.getrandbits(64)
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(distance + 1)))
        assert test(np.array([differ], np.uint64))[0]
        assert any(not differ & m for m in masks), x


def test_refined_blocks_lose_no_pair():
    rng = random.Random(5)
    for mask in simhash.ring_masks(3):
        free = [b for b in range(64) if not mask >> b & 1]
        for _ in range(200):
            differ = sum(1 << b for b in rng.sample(free, rng.randrange(4)))
            assert any(not differ & m for m in hamming.finer(mask, 3))


def test_links_of_crowded_groups(spark, monkeypatch):
    """Groups over the limit are cut by further bits and lose no link."""
    monkeypatch.setattr(hamming, "GROUP_ROWS", 4)
    rng = random.Random(3)
    numbers = list(near_cluster(rng, 150, 5) | near_cluster(rng, 40, 2) | {rng.getrandbits(64) for _ in range(100)})
    stage = Stage(spark)
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(numbers)], "fp bigint, node bigint")
    near = hamming.Nearness(3, simhash.chain_test(3))
    links = hamming.links_within(df, near, simhash.ring_masks(3), stage)
    got = {r.node: r.root for r in components(links, stage).collect()}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(numbers)), 2) if (numbers[i] ^ numbers[j]).bit_count() <= 3]
    assert {n: got.get(n, n) for n in range(len(numbers))} == groups(pairs, range(len(numbers)))
    stage.drop()


@pytest.mark.parametrize("limit", [1, 512])
def test_links_within_a_group(limit, monkeypatch):
    """Both ways to go through a group, over batches that cut groups apart."""
    monkeypatch.setattr(hamming, "GROUP_ROWS", limit)
    rng = random.Random(9)
    rows = []
    for g in range(1, 7):
        for x in near_cluster(rng, 30, 3):
            rows.append((g, 0, signed(x), len(rows)))
    schema = pa.schema([(n, pa.int64()) for n in ("path", "value", "fp", "node")])
    paths = {g: hamming.Path(0, ()) for g in range(1, 7)}
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows[i : i + 7]], schema) for i in range(0, len(rows), 7)]
    edges = [e for b in hamming._links(hamming.Nearness(3), paths)(iter(batches)) for e in zip(*(c.to_pylist() for c in b.columns))]
    pairs = [
        (a[3], b[3])
        for a, b in itertools.combinations(rows, 2)
        if a[0] == b[0] and ((a[2] ^ b[2]) & (2**64 - 1)).bit_count() <= 3
    ]
    nodes = [r[3] for r in rows]
    assert groups(edges, nodes) == groups(pairs, nodes)


def test_a_pair_meets_on_one_path_only():
    """Through all levels: the first mask that it agrees on, then the first of the finer ones."""
    rng = random.Random(8)
    masks = simhash.ring_masks(3)
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(4)))
        paths = hamming.first_paths(masks)
        for _ in range(3):
            met = [n for n, p in paths.items() if not differ & p.mask and all(differ & e for e in p.earlier)]
            assert len(met) == 1
            paths = hamming.finer_paths(met[0], paths[met[0]], 3)


def test_components_of_graphs(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300, 380)]
    hub = [(1000, i) for i in range(1001, 1100)]
    loose = [(rng.randrange(100), rng.randrange(100)) for _ in range(60)]
    edges = chain + hub + loose + [(5, 5), (-4, -9), (-9, 1050)] + chain[:3]
    rng.shuffle(edges)
    stage = Stage(spark)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r.node: r.root for r in components(df, stage).collect()}
    nodes = {n for e in edges for n in e}
    expected = groups(edges, nodes)
    assert {n: got.get(n, n) for n in nodes} == expected
    assert components(df.limit(0), stage).count() == 0
    stage.drop()


def test_near_copies_are_found(spark):
    rng = random.Random(4)
    base = sentence(rng, 400)
    rows = [(i, edited(rng, base, 1)) for i in range(8)]
    found = simhash.simhash_components(documents(spark, rows)).collect()
    assert Counter(r.component_id for r in found).most_common(1)[0][1] >= 5
