"""Packing documents into token sequences by bin completion on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import codec
from tidemark.llm.shared import Stage, arrow_map, col, text_or_empty

#: Lengths of the members of one sequence, largest first.
Filling = tuple[int, ...]
#: Fillings around one largest item that are tried first; nodes of the search, after which the best found so far
#: stands; beginnings of fillings that count as a node.
FIRST, NODES, LOOKED_AT = 6, 6_000, 200


# --- the packing of a histogram ----------------------------------------------------


def least_bins(counts: np.ndarray) -> int:
    """A bound from below: by the sum, and by items that no two bins-halves can share."""
    capacity = len(counts) - 1
    lengths = np.arange(capacity + 1)
    total = counts * lengths
    best = -(-int(total.sum()) // capacity)
    many, size = np.cumsum(counts[::-1])[::-1], np.cumsum(total[::-1])[::-1]
    for small in range(0, capacity // 2 + 1):
        over = capacity - small + 1  # longer than what leaves room for `small`
        alone = int(many[over]) if over <= capacity else 0
        middle = int(many[capacity // 2 + 1]) - alone
        room = middle * capacity - int(size[capacity // 2 + 1] - (size[over] if over <= capacity else 0))
        low = int(size[small] - size[capacity // 2 + 1])
        best = max(best, alone + middle + max(0, -(-(low - room) // capacity)))
    return best


def best_fit(counts: np.ndarray) -> Counter[Filling]:
    """Best-fit decreasing, for all items of a length at once: the first incumbent."""
    capacity = len(counts) - 1
    open_bins: dict[int, Counter[Filling]] = {}
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            room = min((r for r in open_bins if r >= length), default=capacity)
            each = min(room // length, left)
            if room == capacity and room not in open_bins:
                filling, bins = (), left // each
            else:
                filling, n = next(iter(open_bins[room].items()))
                bins = min(n, left // each)
                open_bins[room][filling] -= bins
                if not open_bins[room][filling]:
                    del open_bins[room][filling]
                if not open_bins[room]:
                    del open_bins[room]
            after = room - each * length
            open_bins.setdefault(after, Counter())[(*filling, *[length] * each)] += bins
            left -= bins * each
    return sum(open_bins.values(), Counter())


def fillings(counts: np.ndarray, room: int) -> list[tuple[int, Filling]]:
    """Promising ways to fill ``room``: ``(waste, lengths)``, the least waste first.

    A single item that fills it exactly dominates every other way. Otherwise each
    length that fits leads one filling, completed by the longest that still fit;
    of equal waste, one with fewer and longer items dominates the others.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [(room, ())]
    if have[-1] == room:
        return [(0, (room,))]
    fitting = np.zeros(room + 1, np.int64)  # the longest available item up to each length
    fitting[have] = have
    fitting = np.maximum.accumulate(fitting)
    lead = have[::-1]
    columns, rest = [lead], room - lead
    while True:
        item = np.minimum(fitting[rest], columns[-1] if len(columns) > 1 else fitting[rest])
        if not item.any():
            break
        columns.append(item)
        rest = rest - item
    found: list[tuple[int, Filling]] = []
    for at in np.lexsort((np.arange(len(lead)), rest)):
        lengths = sorted((int(c[at]) for c in columns if c[at]), reverse=True)
        need = Counter(lengths)
        while any(counts[x] < n for x, n in need.items()):  # fewer there than the filling repeats
            lengths.remove(min(x for x, n in need.items() if counts[x] < n))
            need = Counter(lengths)
        waste = room - sum(lengths)
        if not any(w <= waste and set(other) >= set(lengths) for w, other in found):
            found.append((waste, tuple(lengths)))
        if len(found) >= FIRST:
            break
    return sorted(found)


def every_filling(counts: np.ndarray, room: int) -> Iterator[tuple[int, Filling] | None]:
    """The promising fillings, then all others that no filling dominates by one item more or by a longer one for one.

    They are made as far as they are asked for; None stands for ``LOOKED_AT`` beginnings
    of fillings that led to nothing.
    """
    first = fillings(counts, room)
    yield from first
    if not first[0][1] or first[0][1] == (room,):
        return
    told = {lengths for _, lengths in first}
    have = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1]]
    left = [int(counts[x]) for x in have]
    looked = 0

    def grow(rest: int, begin: int, most: int, chosen: Filling) -> Iterator[tuple[int, Filling] | None]:
        """``most`` is the waste up to which no chosen item can be replaced by a longer one."""
        nonlocal looked
        looked += 1
        if looked % LOOKED_AT == 0:
            yield None
        smallest = next((x for x, n in zip(reversed(have), reversed(left)) if n), room + 1)
        if rest < smallest:
            if rest <= most and chosen not in told:
                yield rest, chosen
            return
        longer = None  # the next longer length that is left over
        for n in range(len(have)):
            x = have[n]
            if n >= begin and x <= rest and left[n]:
                allowed = most if longer is None else min(most, longer - x - 1)
                left[n] -= 1
                yield from grow(rest - x, n, allowed, (*chosen, x))
                left[n] += 1
            if left[n]:
                longer = x

    yield from grow(room, 0, room, ())


def pack(counts: np.ndarray) -> Counter[Filling]:
    """How many sequences to fill in which way; ``counts[n]`` items of length n.

    Bin completion: around the largest item that is left, undominated fillings are
    tried, first some with little waste, each as often as its items last and then less
    often. A branch ends when its waste shows that it can't beat the incumbent, which is
    the best-fit packing at first; the search ends when the incumbent meets the lower
    bound, when nothing is left to try, or after ``NODES`` steps.
    """
    capacity = len(counts) - 1
    best = best_fit(counts)
    bound, total = least_bins(counts), int((counts * np.arange(capacity + 1)).sum())
    best_bins, nodes = sum(best.values()), 0
    path: list[tuple[Filling, int]] = []
    # a frame: the fillings still to try, the counts before them, the waste before them
    frames: list[tuple[Iterator, np.ndarray, int, int]] = []

    def open_frame(left: np.ndarray, waste: int) -> bool:
        at = np.flatnonzero(left)
        if not len(at):
            return False
        largest = int(at[-1])
        without = left.copy()
        without[largest] -= 1
        frames.append((branches(without, left, largest, waste), left, waste, largest))
        return True

    def branches(without: np.ndarray, left: np.ndarray, largest: int, waste: int):
        """Fillings with how often they are used, most often first."""
        for found in every_filling(without, capacity - largest):
            if found is None:
                yield None
                continue
            loss, lengths = found
            need = Counter((largest, *lengths))
            times = min(int(left[x]) // n for x, n in need.items())
            allowed = (best_bins - 1) * capacity - total - waste  # more waste than this is no improvement
            if loss:
                times = min(times, allowed // loss)
            for n in range(times, 0, -1):
                yield loss, lengths, n

    open_frame(counts.astype(np.int64), 0)
    while frames and best_bins > bound and nodes < NODES:
        tried, left, waste, largest = frames[-1]
        step = next(tried, ())
        del path[len(frames) - 1 :]
        if step == ():
            frames.pop()
            continue
        nodes += 1
        if step is None:
            continue
        loss, lengths, times = step
        filling = (largest, *lengths)
        need = Counter(filling)
        if waste + loss * times > (best_bins - 1) * capacity - total:  # the incumbent may be better by now
            continue
        after = left.copy()
        for x, n in need.items():
            after[x] -= n * times
        path.append((filling, times))
        if not open_frame(after, waste + loss * times):
            bins = sum(t for _, t in path)
            if bins < best_bins:
                best_bins, best = bins, Counter()
                for f, t in path:
                    best[f] += t
            path.pop()
    return best


class Slots:
    """Where the n-th item of each length goes."""

    def __init__(self, packing: Counter[Filling]):
        by_length: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: Counter[int] = Counter()
        base = 0
        for filling, times in sorted(packing.items(), reverse=True):
            offset = 0
            for length, each in Counter(filling).items():
                by_length.setdefault(length, []).append((taken[length], each, base, offset))
                taken[length] += each * times
                offset += length * each
            base += times
        self.tables = {length: np.array(rows, np.int64).T for length, rows in by_length.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for n in np.unique(length):
            at = length == n
            first, each, base, begin = self.tables[int(n)]
            row = np.searchsorted(first, rank[at], "right") - 1
            nth = rank[at] - first[row]
            sequence[at] = base[row] + nth // each[row]
            offset[at] = begin[row] + nth % each[row] * n
        return sequence, offset


# --- the operator ------------------------------------------------------------------


def _pieces(vocabulary: str, capacity: int, end_id: int, names: list[str]):
    """Encoded texts, cut; each piece knows how many of its length came before it in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, here = codec(vocabulary), Counter(), TaskContext.get().partitionId()
        for b in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for n, text in enumerate(b.column("text")):
                ids = np.append(bpe.encode(text.as_py(), shared=False), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    row.append(n)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[a:z].tobytes()))
                    nth.append(seen[z - a])
                    seen[z - a] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(row, pa.int32())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, nth)),
                    pa.array([here] * len(row), pa.int32()),
                ],
                names=names,
            )

    return run


def _placed(slots: Slots, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = slots.place(length, rank)
            kept = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return run


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    stage: Stage | None = None,
) -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset``: one row per piece.

    Each text is encoded and closed with ``end_id``; what is longer than
    ``capacity`` is cut into pieces of that length, of which the first may be
    shorter. Only lengths matter for the packing, so :func:`pack` works on their
    histogram, which has ``capacity`` numbers whatever the size of the corpus; the
    pieces of each length then take its places by rank. Ranks come from counts per
    partition and length, so a length that a third of all pieces have is no hot key.

    A missing or empty text is the closing id alone. Rows without an id and repeated
    rows are packed like any others; an empty table gives none.
    """
    stage = stage or Stage(docs.sparkSession)
    shape = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "nth")),
            T.StructField("part", T.IntegerType()),
        ]
    )
    texts = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    pieces = stage.table(arrow_map(texts, _pieces(vocabulary, capacity, end_id, shape.names), shape))

    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = stage.table(per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))))
    counts = np.zeros(capacity + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        counts[row["length"]] = row["n"]
    slots = Slots(pack(counts))

    ranked = pieces.join(per_part.drop("n"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    placed = T.StructType([*shape.fields[:5], *(T.StructField(c, T.LongType()) for c in ("sequence_id", "offset"))])
    return arrow_map(ranked, _placed(slots, placed.names), placed)
