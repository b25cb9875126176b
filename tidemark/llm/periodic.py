"""Periodic runs of words: recompression into a run-length grammar, whose LCE queries extend candidates."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import arrow_map, col, slices, text_or_empty

#: Words that share a grammar (a text of more has its own), and grid pairs looked at in one go.
GRAMMAR_WORDS, PAIRS_AT_ONCE = 1 << 17, 1 << 19

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class _Level:
    """One string of the grammar: its symbols, and where each symbol's children begin one level below."""

    __slots__ = ("symbols", "first", "parent", "blocks")

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None):
        self.symbols, self.first = symbols, first
        self.parent: np.ndarray | None = None  # of each symbol, on the next level
        self.blocks = False  # whether the next level has this one's blocks of equal symbols


def _renamed(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _blocks(s: np.ndarray) -> np.ndarray | None:
    """True where a block of equal symbols begins; None if all blocks are single symbols."""
    begins = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=begins[1:])
    return None if begins.all() else begins


def _pairs(s: np.ndarray, level: int) -> np.ndarray | None:
    """True where a symbol of the next level begins, when each left symbol joins a right one behind it.

    Which symbols are left and which right is decided by a bit of the symbol; of
    some such partitions the one with most pairs counts.
    """
    most, best = 0, None
    for k in range(6):
        right = (((s.astype(np.uint64) + np.uint64(level * 8 + k + 1)) * _SPREAD) >> np.uint64(40)) & np.uint64(1) > 0
        joins = right[1:] & ~right[:-1]
        n = int(joins.sum())
        if n > most:
            most, best = n, joins
        if most * 5 >= len(s):
            break
    if best is None:
        return None
    begins = np.ones(len(s), bool)
    begins[1:] = ~best
    return begins


class Grammar:
    """A string, compressed in turns: blocks of equal symbols to one, then pairs to one.

    Equal symbols of a level stand for equal words, so two suffixes are compared
    symbol by symbol: upwards while both begin symbols of the next level, then
    down again where they differ. As what is joined depends on the symbols alone,
    equal stretches are cut alike but for their ends, and a comparison takes a
    step or two a level. The first and last word and those between texts must
    occur once.
    """

    def __init__(self, words: np.ndarray):
        self.levels = [_Level(_renamed(words), None)]
        while len(s := self.levels[-1].symbols) > 2:
            blocks = _blocks(s)
            begins = _pairs(s, len(self.levels)) if blocks is None else blocks
            if begins is None:
                break
            first = np.flatnonzero(begins)
            sizes = np.diff(first, append=len(s))
            if blocks is None:
                second = np.where(sizes > 1, s[np.minimum(first + 1, len(s) - 1)] + 1, 0)
                keys = s[first] * (int(s.max()) + 2) + second
            else:
                keys = s[first] * (int(sizes.max()) + 1) + sizes
            below = self.levels[-1]
            below.parent, below.blocks = np.cumsum(begins) - 1, blocks is not None
            self.levels.append(_Level(_renamed(keys), np.append(first, len(s))))

    def extend(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``x`` and ``y`` on agree (or before them, both included, if not ``forward``); x <> y."""
        d = 1 if forward else -1
        held = {0: [(np.arange(len(x)), x, y)]}
        last = 0
        for k, level in enumerate(self.levels):  # upwards
            rows, a, b = (np.concatenate(c) for c in zip(*held.pop(k)))
            stopped = []
            while len(rows):
                equal = level.symbols[a] == level.symbols[b]
                stopped.append((rows[~equal], a[~equal], b[~equal]))
                rows, a, b = rows[equal], a[equal], b[equal]
                if level.parent is None:
                    a, b = a + d, b + d
                    continue
                above, edge = self.levels[k + 1], 0 if forward else 1
                up, vp = level.parent[a], level.parent[b]
                begins = (above.first[up + edge] - edge == a) & (above.first[vp + edge] - edge == b)
                held.setdefault(k + 1, []).append((rows[begins], up[begins], vp[begins]))
                rows, a, b = self._stepped(k, rows[~begins], a[~begins], b[~begins], d)
            held[k] = stopped
            last = k
            if not any(len(c[0]) for c in held.get(k + 1, [])):
                break
        found = np.zeros(len(x), np.int64)
        rows, a, b = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(last, -1, -1):  # downwards: all that come here differ on the level above
            level = self.levels[k]
            parts, open_ = list(held[k]), (rows, a, b)
            while len(open_[0]):
                rows, a, b = open_
                equal = level.symbols[a] == level.symbols[b]
                parts.append((rows[~equal], a[~equal], b[~equal]))
                open_ = self._stepped(k, rows[equal], a[equal], b[equal], d)
            rows, a, b = (np.concatenate(c) for c in zip(*parts))
            if k:
                a, b = (level.first[a], level.first[b]) if forward else (level.first[a + 1] - 1, level.first[b + 1] - 1)
        found[rows] = (a - x[rows]) * d
        return found

    def _stepped(self, k: int, rows: np.ndarray, a: np.ndarray, b: np.ndarray, d: int) -> tuple[np.ndarray, ...]:
        """Past an equal symbol, or past as much of two equal blocks as both still have."""
        level = self.levels[k]
        if not level.blocks:
            return rows, a + d, b + d
        first = self.levels[k + 1].first
        if d > 0:
            left = np.minimum(first[level.parent[a] + 1] - a, first[level.parent[b] + 1] - b)
        else:
            left = np.minimum(a - first[level.parent[a]], b - first[level.parent[b]]) + 1
        return rows, a + d * left, b + d * left


def _grid(sizes: np.ndarray, total: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``position, period`` at every multiple of each period, among the texts that are long enough for it.

    ``sizes`` are words with the border behind them, in falling order.
    """
    reach = np.cumsum(sizes)
    longest = int(sizes[0] - 1) // 2
    periods = np.arange(1, longest + 1)
    fits = len(sizes) - np.searchsorted(sizes[::-1], np.maximum(2 * periods, least) + 1)
    ends = reach[np.maximum(fits, 1) - 1]
    counts = np.where(fits > 0, -(-np.maximum(ends - periods, 0) // periods), 0)
    at = 0
    sums = np.cumsum(counts)
    while at < longest:
        done = sums[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sums, done + PAIRS_AT_ONCE, "right")))
        own, n = periods[at:to], counts[at:to]
        period = np.repeat(own, n)
        nth = np.arange(len(period)) - np.repeat(np.cumsum(n) - n, n)
        yield nth * period, period
        at = to


def find_runs(texts: list[np.ndarray], least: int = 12) -> tuple[np.ndarray, ...]:
    """``text, start, length, period`` of all runs of several texts, given as word numbers from 0.

    A run of a period holds a multiple of it among its first words, whose word
    stands again a period later; from each such pair both sides are extended by
    the grammar. The shortest period found for a stretch is its smallest.
    """
    order = np.argsort([-len(t) for t in texts], kind="stable")
    sizes = np.array([len(texts[i]) + 1 for i in order], np.int64)
    sizes = sizes[sizes > least]
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    if not len(sizes):
        return none
    order = order[: len(sizes)]
    border = max(int(t.max()) for t in (texts[i] for i in order)) + 1
    joined = np.empty(int(sizes.sum()) + 1, np.int64)
    joined[0], at = border, 1
    for k, i in enumerate(order):
        joined[at : at + sizes[k] - 1] = texts[i]
        at += sizes[k]
        joined[at - 1] = border + k + 1
    whose = np.repeat(np.arange(len(sizes)), sizes)
    words, grammar, spans = joined[1:], None, []
    for position, period in _grid(sizes, len(words), least):
        other = position + period
        agree = words[position] == words[other]
        position, period, other = position[agree], period[agree], other[agree]
        # a run has another such pair beside this one, unless one is all that it needs
        beside = (joined[position] == joined[other]) | (words[position + 1] == words[other + 1])
        beside |= np.maximum(period, least - period) < 2
        beside &= whose[position] == whose[other]
        position, period = position[beside], period[beside]
        if not len(position):
            continue
        grammar = grammar or Grammar(joined)
        x, y = position + 1, position + period + 1
        ahead, back = grammar.extend(x, y, True), grammar.extend(x - 1, y - 1, False)
        kept = (ahead + back >= period) & (ahead + back + period >= least)
        start = position[kept] - back[kept]
        spans.append((start, start + (ahead + back + period)[kept], period[kept]))
    if not spans:
        return none
    start, end, period = (np.concatenate(c) for c in zip(*spans))
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    text = whose[start]
    own = start - (np.cumsum(sizes) - sizes)[text]
    return order[text], own, end - start, period


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run holds after its first period."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """``row, n_words, runs, collapsed`` for every row, which stands whole in ``row``.

    Words are what white space of ASCII separates. A run is a stretch of words
    with smallest period q, at least ``least`` and 2q of them, that can't be made
    longer by a neighbouring word; ``runs`` has ``start, length, period`` of all,
    by start and period. Runs may overlap. ``collapsed`` is the text without the
    words that some run holds after its first q, one space between words. Texts
    are searched within their task, several in one grammar, a long one in its own,
    and nothing is shuffled. A missing or empty text has no words and no runs;
    rows without an id and repeated rows stay; an empty table gives none.
    """
    number = pa.int64()
    kind = pa.list_(pa.struct([("start", number), ("length", number), ("period", number)]))

    def some(texts: list[list[bytes]]) -> Iterator[tuple[int, list[tuple], bytes]]:
        numbers = defaultdict(count().__next__)
        words = [np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in texts]
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        text, *spans = find_runs(words, least)
        for i, *run in zip(text.tolist(), *(c.tolist() for c in spans)):
            runs[i].append(tuple(run))
        for i, t in enumerate(texts):
            own = sorted(runs.get(i, ()), key=lambda r: (r[0], r[2]))
            yield len(t), own, collapse(t, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            found, held, size = [], [], 0
            for text in b.column("text"):
                held.append(text.as_py().encode().split())
                size += len(held[-1])
                if size >= GRAMMAR_WORDS:
                    found += some(held)
                    held, size = [], 0
            found += some(held)
            runs = [[dict(zip(("start", "length", "period"), r)) for r in own] for _, own, _ in found]
            columns = [pa.array([f[0] for f in found], number), pa.array(runs, kind)]
            columns.append(pa.array([f[2].decode() for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns], ["row", "n_words", "runs", "collapsed"])

    long = T.LongType()
    spans = T.StructType([T.StructField(n, long) for n in ("start", "length", "period")])
    shape = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("n_words", long),
            T.StructField("runs", T.ArrayType(spans)),
            T.StructField("collapsed", T.StringType()),
        ]
    )
    whole = F.struct(*[col(c) for c in docs.columns]).alias("row")
    return arrow_map(docs.select(whole, text_or_empty(text_col).alias("text")), run, shape)
