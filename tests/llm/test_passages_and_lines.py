from __future__ import annotations

import itertools
import os
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import documents, edited, groups, messy_rows, sentence

from tidemark.llm import line_blocks, lines, substring
from tidemark.llm.shared import Stage, components, signed


# --- repeated passages ---------------------------------------------------------


def slow_removal(rows, window):
    """What each row keeps: its words, less those of windows that start in a row with a smaller id."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    kept = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return kept


def told(found):
    return Counter((r.row.doc_id, r.n_words, r.n_removed, b" ".join((r.kept or "").encode().split())) for r in found)


def test_removed_words_equal_brute_force(spark):
    rows = messy_rows()
    docs = documents(spark, rows)
    for window in (6, 20):
        found = substring.remove_repeated(docs, window=window)
        assert told(found.collect()) == Counter(slow_removal(rows, window))
    assert found.select("row.*").columns == docs.columns
    untouched = {r.row.text for r in found.collect() if not r.n_removed}
    assert untouched <= {t for _, t in rows}


def test_windows_that_repeat_a_word(spark):
    """Periodic texts: every window has many equal halves."""
    rows = [(1, "a " * 40 + "b"), (2, "a " * 25), (3, "b " + "a " * 12), (4, "a b " * 20), (5, "b a " * 20)]
    found = substring.remove_repeated(documents(spark, rows), window=10).collect()
    assert told(found) == Counter(slow_removal(rows, 10))


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    rng = random.Random(1)
    words = [w.encode() for w in sentence(rng, 500).split()]
    whole = [np.concatenate([substring.signatures(h, 5, 10) for _, h in substring.blocks(words, 10)])]
    monkeypatch.setattr(substring, "BLOCK", 37)
    parts = [substring.signatures(h, 5, 10) for _, h in substring.blocks(words, 10)]
    assert np.array_equal(whole[0], np.concatenate(parts))
    assert len(whole[0]) == 500 - 10 + 1


def test_rest_of_a_text_keeps_its_separators():
    gone = np.array([False, True, True, False, True, False, False, True])
    assert substring.without_words(b" a  b c\td\ne f g\nh ", gone) == b" a  d\nf g\n"
    assert substring.without_words(b"a b", np.array([True, True])) == b""


def test_no_passages(spark):
    assert substring.remove_repeated(documents(spark, [])).count() == 0
    rows = [(1, None), (2, ""), (3, "short"), (None, "no id " * 60), (None, "no id " * 60)]
    found = substring.remove_repeated(documents(spark, rows)).collect()
    assert sorted(r.n_removed for r in found) == [0] * 5


# --- similar lines ---------------------------------------------------------------


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(600):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("abcé") for _ in range(rng.randrange(12)))
        d = slow_distance(a, b)
        assert lines.levenshtein(a, b, 99) == d
        for limit in range(4):
            assert (lines.levenshtein(a, b, limit) <= limit) == (d <= limit)
    long = sentence(rng, 60)
    other = edited(rng, long, 5)
    assert lines.levenshtein(long, other, 10_000) == slow_distance(long, other)


def test_word_distance_bounds_edit_distance():
    rng = random.Random(5)
    for _ in range(400):
        a = " ".join(rng.choice(["a", "bc", "def", "gh"]) for _ in range(rng.randrange(1, 9)))
        words = a.split(" ")
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = rng.choice(["", "bc", "xyz", "a bc"])
        b = " ".join(w for w in " ".join(words).split(" ") if w) or "a"
        assert lines.word_distance(a, b) >= slow_distance(a, b)
        for least in (0.5, 0.8):
            similarity = 1 - slow_distance(a, b) / max(len(a), len(b))
            assert lines.similar_lines(least)(a, b) == (similarity >= least - 1e-9)


def test_line_fingerprints(monkeypatch):
    rng = random.Random(4)
    sizes = np.array([1, 2, 3, 50, 300, 7])
    hashes = np.array([rng.getrandbits(64) for _ in range(sizes.sum())], np.uint64)
    expected, at = [], 0
    for n in sizes:
        own = [int(h) for h in hashes[at : at + n]]
        expected.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n))
        at += n
    assert lines.simhash_many(hashes, sizes).tolist() == expected
    monkeypatch.setattr(lines, "_LANE_WORDS", 5)
    assert lines.simhash_many(hashes, sizes).tolist() == expected


def slow_lines(rows, distance=3, similarity=0.8):
    """Where each line stands, the group of each distinct line, and how many pairs are similar."""
    occurrences = []
    for key in {(i is None, -1 if i is None else i, t or "") for i, t in rows}:
        for n, words in enumerate(lines.normal_lines(key[2])):
            if words:
                occurrences.append((key, n, b" ".join(words)))
    distinct = sorted({o[2] for o in occurrences})
    prints = {}
    for line in distinct:
        own = [xxhash.xxh64_intdigest(w, 0) for w in line.split()]
        prints[line] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
    pairs = []
    for a, b in itertools.combinations(distinct, 2):
        if (prints[a] ^ prints[b]).bit_count() <= distance:
            x, y = a.decode(), b.decode()
            if 1 - slow_distance(x, y) / max(len(x), len(y)) >= similarity - 1e-9:
                pairs.append((a, b))
    root = groups(pairs, distinct)
    return occurrences, root, len(pairs)


def test_similar_lines_equal_brute_force(spark):
    rows = messy_rows()
    found = lines.remove_similar_lines(documents(spark, rows)).collect()
    occurrences, root, n_pairs = slow_lines(rows)
    assert n_pairs > 0

    def order(o):
        (missing, i, text), n, _ = o
        return (missing, i, signed(xxhash.xxh64_intdigest(text.encode(), 42)), n)

    first = {}
    for o in sorted(occurrences, key=order):
        first.setdefault(root[o[2]], o)
    gone = {}
    for o in occurrences:
        if first[root[o[2]]] is not o:
            gone.setdefault(o[0], set()).add(o[1])
    expected = Counter()
    for i, t in rows:
        drop = gone.get((i is None, -1 if i is None else i, t or ""), set())
        own = t.split("\n") if t else []
        kept = "\n".join(x for n, x in enumerate(own) if n not in drop) if drop else t
        expected[(i, kept, len(own), len(drop))] += 1
    assert Counter((r.row.doc_id, r.kept, r.n_lines, r.n_removed) for r in found) == expected


def test_lines_of_nothing(spark):
    docs = documents(spark, [])
    assert lines.remove_similar_lines(docs).count() == 0
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "---\n***"), (None, "a b")]
    found = {r.row.doc_id: (r.kept, r.n_removed) for r in lines.remove_similar_lines(documents(spark, rows)).collect()}
    assert found == {1: (None, 0), 2: ("", 0), 3: ("\n\n", 0), 4: ("---\n***", 0), None: ("a b", 0)}


def test_case_digits_and_punctuation_do_not_matter(spark):
    rows = [(2, "Page 12 of 40.\nother words here"), (1, "page 7 of 9"), (3, "first\nPAGE: 1 OF 2!\nlast")]
    found = {r.row.doc_id: r.kept for r in lines.remove_similar_lines(documents(spark, rows)).collect()}
    assert found == {1: "page 7 of 9", 2: "other words here", 3: "first\nlast"}


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_similar_lines_meet_without_a_distance(spark, monkeypatch, group_rows):
    """Recall against edit similarity alone: every pair of lines is compared, none by its fingerprint."""
    monkeypatch.setattr(line_blocks, "GROUP_ROWS", group_rows)
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 10))) for _ in range(400)]
    texts = []
    for n in range(120):
        words = [rng.choice(vocabulary) for _ in range((5, 12, 25, 60)[n % 4])]
        other = list(words)
        for _ in range(max(1, len(words) // 8)):
            other[rng.randrange(len(other))] = rng.choice(vocabulary)
        texts += [" ".join(words), " ".join(other)]
    alike = lines.similar_lines(0.8)
    pairs = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if alike(texts[a], texts[b])]
    root = groups(pairs, range(len(texts)))
    repeats = {n for n in root if root[n] != n}
    docs = documents(spark, list(enumerate(texts)))
    found = {r.row.doc_id for r in lines.remove_similar_lines(docs, distance=None).collect() if r.n_removed}
    assert len(repeats) > 80
    assert found <= repeats and len(found) >= 0.9 * len(repeats)


def test_lines_that_differ_in_numbers_must_be_similar(spark):
    rows = [(1, "3"), (2, "123456789"), (3, "12 34 56"), (4, "7 80 9123"), (5, "Total: 12.50 EUR"), (6, "total: 9,871 eur")]
    rows += [(7, "sent on 12 March 2019 to all of the members"), (8, "Sent on 13 March 2019, to all of the members!")]
    docs = documents(spark, rows)
    found = {r.row.doc_id: r.n_removed for r in lines.remove_similar_lines(docs, distance=None, digits=True).collect()}
    assert found == {i: int(i == 8) for i in range(1, 9)}


def packed(node, fp, low, step=None, part=None):
    n = len(node)
    full = {"node": node, "fp": fp, "low": low, "step": step if step is not None else np.full(n, 80)}
    full["part"] = np.zeros(n) if part is None else part
    rows = {name: np.asarray(full[name]).astype(kind) for name, kind in line_blocks._FIELDS}
    return (n, b"".join(rows[name].tobytes() for name, _ in line_blocks._FIELDS))


def slow_near(rows, tile=False, steps=7):
    """Indices of near pairs: loose bits that agree but for one, and what else a pair must have."""
    out = set()
    for i, j in itertools.combinations(range(len(rows["node"])), 2):
        near = int(rows["low"][i] ^ rows["low"][j]).bit_count() <= line_blocks.DIFFERING
        near &= int(rows["fp"][i] ^ rows["fp"][j]).bit_count() <= line_blocks.FAR
        near &= abs(int(rows["step"][i]) - int(rows["step"][j])) <= steps
        if near and (not tile or rows["part"][i] != rows["part"][j]):
            out.add((i, j))
    return out


@pytest.mark.parametrize("light", [64, 3, 0])
@pytest.mark.parametrize("differing", [1, 2])
@pytest.mark.parametrize("tile", [False, True])
def test_near_pairs_of_a_group(monkeypatch, light, differing, tile):
    monkeypatch.setattr(line_blocks, "LIGHT", light)
    monkeypatch.setattr(line_blocks, "DIFFERING", differing)
    rng = np.random.default_rng(light + tile)
    for n, lows, spread in [(2, 1, 2), (40, 3, 6), (60, 8, 9), (150, 4, 12), (80, 1 << 14, 2)]:
        centres = rng.integers(0, 2**63, 4, np.uint64)
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, spread), np.uint64), axis=1)
        blob = packed(rng.permutation(n), centres[rng.integers(0, 4, n)] ^ flips, rng.integers(0, lows, n),
                      rng.integers(70, 90, n), rng.integers(0, 2, n))
        rows = line_blocks._unpacked([blob])
        expected = slow_near(rows, tile)
        x, y = line_blocks._Pairs(rows, tile, 0.8, np.arange(n), True).run()
        forest = {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
        assert forest <= expected
        want = groups(expected, range(n))
        assert groups(forest, range(n)) == want and len(forest) == n - len(set(want.values()))
        roots = rng.integers(0, 3, n)
        up = np.array([np.flatnonzero(roots == r)[0] for r in roots])
        x, y = line_blocks._Pairs(rows, tile, 0.8, up, False).run()
        found = {(min(p), max(p)) for p in zip(x.tolist(), y.tolist())}
        assert found == {(i, j) for i, j in expected if roots[i] != roots[j]}


def test_a_crowded_group_is_dealt_over_tiles():
    """Every two lines of a group meet in a tile as long as they are of different parts, or in their part's own."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    node = rng.permutation(300).astype(np.int64)
    prints = np.zeros((300, line_blocks.FP_WORDS), "<u8")
    lines_in = pa.RecordBatch.from_pydict({"node": node, "fp": [p.tobytes() for p in prints], "size": [10] * 300})
    dealt = list(line_blocks._into_groups({0: 4})(iter([lines_in, lines_in.slice(0, 50)])))
    sizes = [r for b in line_blocks._group_sizes(iter([lines_in])) for r in b.to_pylist()]
    assert sizes == [{"g": k << line_blocks.WHOLE, "rows": 300} for k in range(line_blocks.BLOCKS)]
    met, tiles = Counter(), 0
    for r in (r for b in dealt for r in b.to_pylist()):
        if r["g"] == 0:
            tiles += 1
            assert r["rows"] < 300
            rows = line_blocks._unpacked([(r["rows"], r["data"])])
            own = list(zip(rows["node"].tolist(), rows["part"].tolist()))
            for (x, p), (y, q) in itertools.combinations(own, 2):
                if r["a"] == r["b"] or p != q:
                    met[frozenset((x, y))] += 1
    assert tiles == 10 and len(met) == 300 * 299 // 2 and set(met.values()) == {1}


def slow_prints(line):
    """Bits of a wide fingerprint, one by one."""
    hashes, lengths, _ = line_blocks.word_hashes([line])
    weights = [int(n**0.5) for n in lengths.tolist()]
    out = []
    for k in range(line_blocks.FP_WORDS):
        mixed = line_blocks._mixed(hashes, k).tolist()
        for bit in range(64):
            out.append(2 * sum(w for h, w in zip(mixed, weights) if h >> bit & 1) > sum(weights))
    return out


def test_wide_fingerprints():
    rng = random.Random(9)
    parts = ["a", "bb", "ccc", "été", "x" * 300, "word", "日本"]
    texts = [" ".join(rng.choice(parts) for _ in range(n)).encode() for n in (1, 2, 3, 9, 60, 300, 6000)]
    prints = line_blocks.fingerprints(texts)
    values = line_blocks.block_values(prints)
    for n, text in enumerate(texts):
        bits = slow_prints(text)
        assert np.unpackbits(prints[n : n + 1].view(np.uint8), bitorder="little").astype(bool).tolist() == bits
        for k in range(line_blocks.BLOCKS):
            width = line_blocks.WHOLE + line_blocks.LOOSE
            assert int(values[k][n]) == sum(b << i for i, b in enumerate(bits[k * width : (k + 1) * width]))
    hashes = {}
    h, lengths, sizes = line_blocks.word_hashes(texts)
    assert sizes.tolist() == [len(t.split()) for t in texts]
    for word, value in zip(b" ".join(texts).split(), h.tolist()):
        assert hashes.setdefault(word, value) == value
    assert len(set(hashes.values())) == len(hashes)


def slow_registered(rows, similarity=0.8):
    """The registered configuration by its definition: all pairs of lines, their blocks and their texts."""
    occurrences = []
    for key in {(i is None, -1 if i is None else i, t or "") for i, t in rows}:
        for n, words in enumerate(lines.normal_lines(key[2], True)):
            if words:
                occurrences.append((key, n, b" ".join(words)))
    distinct = sorted({o[2] for o in occurrences})
    prints = line_blocks.fingerprints(distinct)
    values = line_blocks.block_values(prints).T.tolist()
    elsewhere = np.stack([line_blocks.other_word(prints, k) for k in range(line_blocks.BLOCKS)], 1).tolist()
    steps = line_blocks.size_steps(np.array([len(t.decode()) for t in distinct])).tolist()
    whole = (1 << line_blocks.WHOLE) - 1
    pairs = []
    for i, j in itertools.combinations(range(len(distinct)), 2):
        meet = any(
            (v ^ w) & whole == 0 and (v ^ w).bit_count() <= line_blocks.DIFFERING and (e ^ f).bit_count() <= line_blocks.FAR
            for v, w, e, f in zip(values[i], values[j], elsewhere[i], elsewhere[j])
        )
        far = np.bitwise_count(prints[i] ^ prints[j]).sum() > line_blocks.FAR_IN_ALL
        if meet and not far and abs(steps[i] - steps[j]) <= 7:
            x, y = distinct[i].decode(), distinct[j].decode()
            if 1 - slow_distance(x, y) / max(len(x), len(y)) >= similarity - 1e-9:
                pairs.append((distinct[i], distinct[j]))
    return occurrences, groups(pairs, distinct), len(pairs)


@pytest.mark.parametrize("group_rows", [1 << 20, 4])
def test_registered_configuration_equals_brute_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(line_blocks, "GROUP_ROWS", group_rows)
    rng = random.Random(21)
    rows = messy_rows()
    base = [sentence(rng, n) for n in (6, 15, 40)]
    rows += [(1000 + k, edited(rng, base[k % 3], 1 + k % 4)) for k in range(45)]
    found = lines.remove_similar_lines(documents(spark, rows), distance=None, digits=True).collect()
    occurrences, root, n_pairs = slow_registered(rows)
    assert n_pairs > 50

    def order(o):
        (missing, i, text), n, _ = o
        return (missing, i, signed(xxhash.xxh64_intdigest(text.encode(), 42)), n)

    first = {}
    for o in sorted(occurrences, key=order):
        first.setdefault(root[o[2]], o)
    gone = {}
    for o in occurrences:
        if first[root[o[2]]] is not o:
            gone.setdefault(o[0], set()).add(o[1])
    expected = Counter()
    for i, t in rows:
        drop = gone.get((i is None, -1 if i is None else i, t or ""), set())
        own = t.split("\n") if t else []
        kept = "\n".join(x for n, x in enumerate(own) if n not in drop) if drop else t
        expected[(i, kept, len(own), len(drop))] += 1
    assert Counter((r.row.doc_id, r.kept, r.n_lines, r.n_removed) for r in found) == expected


def test_least_edits_bounds_edit_distance():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert lines.least_edits(a, b) <= slow_distance(a, b)


def test_staged_tables_of_lines_go_when_they_are_not_needed(spark):
    stage = Stage(spark)
    found = lines.remove_similar_lines(documents(spark, messy_rows()), distance=None, digits=True, stage=stage)
    folder = stage.root.removeprefix("file://")
    assert len(os.listdir(folder)) == 1  # the lines that go
    assert found.count() == len(messy_rows())
    stage.drop()


def test_a_very_long_line(spark):
    rng = random.Random(2)
    long = sentence(rng, 90_000)
    near = edited(rng, long, 30)
    rows = [(1, long), (2, near), (3, sentence(rng, 90_000)), (4, "x" * 400_000), (5, "short one\n" + long)]
    found = lines.remove_similar_lines(documents(spark, rows), distance=None, digits=True).collect()
    assert {r.row.doc_id: r.n_removed for r in found} == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}


def test_anchored_distance_bounds_edit_distance():
    rng = random.Random(15)
    close = 0
    for _ in range(300):
        x = [rng.choice(["a", "bb", "the", "é", "same"]) if rng.random() < 0.5 else f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 25))]
        y = list(x)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.randrange(3)] = [rng.choice(["x", "the", "w7"]) for _ in range(rng.randrange(3))]
        a, b = " ".join(x), " ".join(y)
        least, bound = slow_distance(a, b), lines.anchored_distance(a, b)
        assert least <= bound
        close += bound <= least + 6
        a, b = a.replace("w", " "), b.replace("the", "")
        assert slow_distance(a, b) <= lines.anchored_distance(a, b)
    assert close > 200


def test_near_copies_of_other_numbers_of_words_need_no_edit_distance(monkeypatch):
    """Words left out, put in and replaced are told by alignment; the distance itself is quadratic."""
    monkeypatch.setattr(lines, "levenshtein", None)
    rng = random.Random(16)
    for n in range(50):
        x = [f"word{rng.randrange(500)}" for _ in range(120)]
        y = list(x)
        for at in sorted(rng.sample(range(1, 119), 6), reverse=True):
            y[at : at + 1] = [[], ["put", "in"], ["other"]][rng.randrange(3)]
        y.append("more")
        assert lines.similar_lines(0.8)(" ".join(x), " ".join(y))


def test_equal_groups_tell_the_same_pairs(spark):
    """Of lines that meet in several groups in another order, the pairs with the smallest other are told, whatever the order."""
    rng = np.random.default_rng(5)
    told = []
    for _ in range(6):
        order = rng.permutation(60)
        rows = line_blocks._unpacked([packed(order, np.zeros(60), np.zeros(60), rng.integers(80, 87, 60))])
        x, y = line_blocks._Pairs(rows, False, 0.8, np.arange(60), True).run()
        told.append({tuple(sorted(p)) for p in zip(rows["node"][x].tolist(), rows["node"][y].tolist())})
    assert all(t == {(0, n) for n in range(1, 60)} for t in told)


def test_few_links_need_no_rounds(spark):
    rng = random.Random(17)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(n, n + 1) for n in range(400, 440)]
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    links = spark.createDataFrame(pairs, "hi bigint, lo bigint").repartition(7)
    for few, tables in ((1000, 2), (1, 5)):
        stage = Stage(spark)
        found = {r.node: r.root for r in components(links, stage, few).collect()}
        assert found == groups([p for p in pairs if p[0] != p[1]], linked)
        written = len(os.listdir(stage.root.removeprefix("file://")))
        assert written == tables if few > 1 else written >= tables
        stage.drop()
