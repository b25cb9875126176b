"""Numbers near each other in Hamming distance, found through blocks of equal bits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import EDGE, Forest, Stage, arrow_map, batch, signed

#: Larger groups are cut by further bits; below so many free bits a group is small whatever the data.
GROUP_ROWS, FREE_BITS = 4096, 14


def blocks_of(bits: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` blocks that the given bit positions are cut into."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(cuts, cuts[1:])]


def finer(mask: int, distance: int) -> list[int]:
    """Two numbers that agree on ``mask`` and differ in ``distance`` bits agree on one of these, too."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | part for part in blocks_of(free, distance + 1)]


class Path(NamedTuple):
    """A way to a group: the bits that agree, and the masks whose groups come first.

    A pair that agrees on one of the ``earlier`` masks meets there and is left out here.
    """

    mask: int
    earlier: tuple[int, ...]

    @property
    def refinable(self) -> bool:
        return self.mask.bit_count() < 64 - FREE_BITS


def first_paths(masks: list[int]) -> dict[int, Path]:
    return {i + 1: Path(m, tuple(masks[:i])) for i, m in enumerate(masks)}


def finer_paths(number: int, path: Path, distance: int) -> dict[int, Path]:
    masks = finer(path.mask, distance)
    return {number * 32 + i + 1: Path(m, path.earlier + tuple(masks[:i])) for i, m in enumerate(masks)}


class Nearness(NamedTuple):
    """What makes two rows a link.

    ``keep`` tests differing bits and ``sizes`` bounds the ratio of the rows' sizes, for
    many pairs at once; ``alike`` compares two texts.
    """

    distance: int
    keep: Callable[[np.ndarray], np.ndarray] | None = None
    sizes: float | None = None
    alike: Callable[[str, str], bool] | None = None


def _links(near: Nearness, paths: dict[int, Path]):
    """Links within groups of equal (path, value); rows come sorted, groups are of bounded size."""
    names = ["path", "value", "fp", "node", *(["size"] if near.sizes else []), *(["text"] if near.alike else [])]

    def close(rows, a, b) -> np.ndarray:
        """Which pairs of rows are near, by all that can be told without their texts."""
        bits = rows[2].view(np.uint64)
        differ = bits[a] ^ bits[b]
        ok = np.bitwise_count(differ) <= near.distance
        if near.keep is not None:
            ok[ok] = near.keep(differ[ok])
        if near.sizes:
            x, y = rows[4][a][ok] if np.ndim(a) else rows[4][a], rows[4][b][ok]
            ok[ok] = np.minimum(x, y) >= near.sizes * np.maximum(x, y) - 1e-9
        return ok

    def link(forest: Forest, rows, i: int, j: int) -> bool:
        """Connect two near rows; connected ones need no look at their texts."""
        a, b = int(rows[3][i]), int(rows[3][j])
        if forest.find(a) == forest.find(b):
            return True
        if near.alike is not None and not near.alike(rows[-1][i], rows[-1][j]):
            return False
        return forest.join(a, b)

    def compare(rows, size: np.ndarray, forest: Forest) -> None:
        """All pairs of many groups, by their distance in the sorted order; each pair on its first path only.

        Pairs that these rows' own links connect already are left out many at a time.
        """
        up = np.arange(len(rows[0]))  # a row of the same component, never a later one
        left = np.repeat(np.cumsum(size), size) - np.arange(len(rows[0])) - 1  # rows of the group after each
        bits = rows[2].view(np.uint64)
        active, shift = np.flatnonzero(left > 0), 1
        while len(active):
            a = active[close(rows, active, active + shift)]
            a = a[up[a] != up[a + shift]]
            for number in np.unique(rows[0][a]):
                own = a[rows[0][a] == number]
                for mask in paths[int(number)].earlier:
                    own = own[(bits[own] ^ bits[own + shift]) & np.uint64(mask) != 0]
                for i in own.tolist():
                    if link(forest, rows, i, i + shift):
                        x, y = i, i + shift
                        while up[x] != x:
                            x = up[x]
                        while up[y] != y:
                            y = up[y]
                        up[max(x, y)] = min(x, y)
            if len(a):
                while (up[up] != up).any():
                    up = up[up]
            shift += 1
            active = active[left[active] >= shift]

    def walk(rows, forest: Forest) -> None:
        """One group that nothing can cut: from row to row, each compared with those not reached yet."""
        rest = np.arange(len(rows[0]))
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                at = todo.pop()
                reached = close(rows, at, rest)
                for k in np.flatnonzero(reached):
                    reached[k] = link(forest, rows, at, rest[k])
                todo.extend(rest[reached])
                rest = rest[~reached]

    def settle(rows, forest: Forest) -> None:
        start = np.flatnonzero(np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])])
        size = np.diff(np.r_[start, len(rows[0])])
        many = size > GROUP_ROWS
        for i, n in zip(start[many], size[many]):
            walk([r[i : i + n] for r in rows], forest)
        some = np.repeat(~many & (size > 1), size)
        compare([r[some] for r in rows], size[~many & (size > 1)], forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held = Forest(), None
        for b in batches:
            if not b.num_rows:
                continue
            rows = [b.column(n).to_numpy(zero_copy_only=False) for n in names]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            other = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = other[-1] + 1 if len(other) else 0  # the last group may go on in the next batch
            if cut:
                settle([r[:cut] for r in rows], forest)
            held = [r[cut:].copy() for r in rows]
        if held is not None:
            settle(held, forest)
        nodes, roots = forest.stars()
        for at in range(0, len(nodes), 50_000):
            yield batch(EDGE, nodes[at : at + 50_000], roots[at : at + 50_000])

    return run


def _value(paths: dict[int, Path]) -> Column:
    """The bits of ``fp`` that the row's path looks at."""
    entries = [F.lit(x) for number, path in paths.items() for x in (number, signed(path.mask))]
    masks = F.create_map(*[e.cast("int") if i % 2 == 0 else e.cast("bigint") for i, e in enumerate(entries)])
    return F.col("fp").bitwiseAND(F.element_at(masks, F.col("path")))


def _along(rows: DataFrame, numbers: Column) -> DataFrame:
    """The rows once for each of the paths' numbers."""
    return rows.withColumn("path", F.explode(numbers))


def links_within(
    numbers: DataFrame, near: Nearness, first: list[int], stage: Stage, texts: DataFrame | None = None
) -> DataFrame:
    """Links that connect all near rows of ``numbers`` (``fp``, ``node`` and, if sizes count, ``size``).

    ``first`` are masks of which any two near numbers agree on at least one; ``texts``
    (``node``, ``text``) are for ``near.alike``. Groups of equal masked bits are compared
    each in one task while they are small. The larger ones are cut by further bits, of which
    again one block in ``distance + 1`` must agree, until the bits left free bound the
    numbers of a group; no group is sampled or cut off. Links come as contracted stars
    per task: enough for the components, and never all pairs of a group.
    """
    paths = first_paths(first)
    rows = _along(numbers, F.array(*[F.lit(p).cast("int") for p in paths]))
    links = None
    while True:
        sizes = rows.groupBy("path", _value(paths).alias("value")).count().where(f"count > {GROUP_ROWS}")
        cut = [number for number, path in paths.items() if path.refinable]
        large = stage.table(sizes.where(F.col("path").isin(cut)).select("path", "value"))
        any_large = large.limit(1).count() > 0
        valued = rows.withColumn("value", _value(paths))
        ready = valued.join(large, ["path", "value"], "left_anti").drop("value") if any_large else rows
        if texts is not None:
            ready = ready.join(texts, "node")
        dealt = ready.repartition(F.col("path"), _value(paths)).withColumn("value", _value(paths))
        dealt = dealt.sortWithinPartitions("path", "value")
        found = stage.table(arrow_map(dealt, _links(near, paths), "hi bigint, lo bigint"))
        links = found if links is None else links.union(found)
        if not any_large:
            return links
        children = {number: finer_paths(number, paths[number], near.distance) for number in cut}
        entries = [
            x
            for number, own in children.items()
            for x in (F.lit(number).cast("int"), F.array(*[F.lit(c).cast("int") for c in own]))
        ]
        kept = valued.join(large, ["path", "value"], "left_semi").drop("value")
        rows = stage.table(_along(kept, F.element_at(F.create_map(*entries), F.col("path"))))
        paths = {number: path for own in children.values() for number, path in own.items()}
