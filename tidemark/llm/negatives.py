"""Hard negatives of anchors, scored by the Four Russians' method: subset sums looked up by bytes of bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Stage, arrow_map, batch, col
from tidemark.llm.topk import usable

#: Rows of a shard and of a tile of anchors; tables are made, and scores held, for so many anchors and rows at a time.
SHARD_ROWS, TILE_ROWS, ANCHORS_AT_ONCE, ROWS_AT_ONCE = 1 << 12, 1 << 10, 64, 1 << 12
#: A task holds shards of about so many bytes of vectors, past which more tasks share the work.
PART_BYTES = 64 << 20

GROUP = 8  # dimensions whose bits make a byte

_PACKED = pa.schema(
    [("part", pa.int32()), ("dim", pa.int32()), ("planes", pa.int32())]
    + [(n, pa.binary()) for n in ("ids", "labels", "vectors", "limits")]
)
_SHAPE = "part int, dim int, planes int, ids binary, labels binary, vectors binary, limits binary"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

_LOWEST = np.iinfo(np.int64).min


def whole_components(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as longs; beyond them the largest or smallest long."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values)
    inside = np.clip(x, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(x >= 2.0**63, np.iinfo(np.int64).max, inside)


def bit_planes(vectors: np.ndarray) -> np.ndarray:
    """Bits of two's complement: (planes, groups of eight dimensions, rows) bytes, the last plane being the sign."""
    low, high = int(vectors.min(initial=0)), int(vectors.max(initial=0))
    n = max(low.bit_length() if low >= -1 else (-low - 1).bit_length(), high.bit_length()) + 1
    padded = np.zeros((len(vectors), -(-vectors.shape[1] // GROUP) * GROUP), np.int64)
    padded[:, : vectors.shape[1]] = vectors
    planes = [np.packbits((padded >> b & 1).astype(np.uint8), axis=1, bitorder="little").T for b in range(n)]
    return np.ascontiguousarray(np.stack(planes))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): for each byte the sum of the components whose bits it has, doubled up bit by bit."""
    groups = -(-anchors.shape[1] // GROUP)
    padded = np.zeros((len(anchors), groups * GROUP), anchors.dtype)
    padded[:, : anchors.shape[1]] = anchors
    by_group = padded.reshape(len(anchors), groups, GROUP).transpose(1, 2, 0)
    sums = np.zeros((groups, 1 << GROUP, len(anchors)), anchors.dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit : 2 << bit] = sums[:, : 1 << bit] + by_group[:, bit : bit + 1]
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products, from the sign's plane down, doubling what is there before each next one."""
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for k in range(len(planes) - 1, -1, -1):
        total += total
        for group in range(planes.shape[1]):
            looked_up = tables[group].take(planes[k, group], axis=0)
            if k == len(planes) - 1:
                total -= looked_up
            else:
                total += looked_up
    return total


def _narrowest(anchors: np.ndarray, planes: np.ndarray) -> np.dtype:
    """32 bits where all sums fit; longs wrap as their arithmetic does."""
    largest = max(abs(int(anchors.min(initial=0))), abs(int(anchors.max(initial=0))))
    return np.dtype(np.int32 if (largest * anchors.shape[1] << len(planes)) < 2**31 else np.int64)


class _Best:
    """The k best rows of each (anchor, slot): higher scores, then smaller ids."""

    def __init__(self, pairs: int, k: int):
        self._k, self._floor = k, np.full(pairs, _LOWEST)
        self._rows = tuple(np.zeros(0, np.int64) for _ in range(3))

    def add(self, slots: np.ndarray, ids: np.ndarray, scored: np.ndarray, allowed: np.ndarray) -> None:
        """Of (rows, slots) scores those that are allowed."""
        allowed &= scored >= self._floor[slots]
        if len(ids) > self._k:  # partial selection: the k-th score bounds what can count
            shown = np.where(allowed, scored, _LOWEST)
            allowed &= shown >= np.partition(shown, len(ids) - self._k, axis=0)[len(ids) - self._k]
        row, column = np.nonzero(allowed)
        if not len(row):
            return
        new = slots[column], ids[row], scored[row, column].astype(np.int64)
        slot, i, s = (np.concatenate(x) for x in zip(self._rows, new))
        order = np.lexsort((i, ~s, slot))
        slot, i, s = slot[order], i[order], s[order]
        nth = np.arange(len(slot)) - np.searchsorted(slot, slot, "left")
        kept = nth < self._k
        self._rows = slot[kept], i[kept], s[kept]
        full = nth == self._k - 1
        self._floor[slot[full]] = s[full]

    def rows(self) -> tuple[np.ndarray, ...]:
        return self._rows


def _pack(rows_each: int, parts: int, scale: float, planes: bool):
    """Rows of (id, label, vector, limits) as rows of matrices, by dimension; vectors as bit planes or as longs."""

    def matrices(held: list, dim: int) -> pa.RecordBatch:
        ids = np.array([x[0] for x in held], "<i8")
        labels = np.array([x[1] for x in held], "<i8")
        vectors = whole_components(np.array([x[2] for x in held], "<f8").reshape(len(held), dim), scale)
        part = int(ids[0] * 0x9E3779B1 >> 7) % parts
        shown = bit_planes(vectors) if planes else vectors.astype("<i8")
        limits = b"".join(x[3] for x in held)
        n = len(shown) if planes else 0
        return batch(_PACKED, [part], [dim], [n], [ids.tobytes()], [labels.tobytes()], [shown.tobytes()], [limits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            limits = [np.array(x, "<i8").tobytes() for x in b.column("limits").to_pylist()]
            rows = zip(b.column("id").to_pylist(), b.column("label").to_pylist(), b.column("vector"), limits)
            for i, label, vector, limit in rows:
                values = vector.values.to_numpy(zero_copy_only=False)
                own = held.setdefault(len(values), [])
                own.append((i, label, values.astype("<f8"), limit))
                if len(own) >= rows_each:
                    yield matrices(held.pop(len(values)), len(values))
        for dim, own in held.items():
            yield matrices(own, dim)

    return run


class _Shard:
    def __init__(self, row: dict):
        self.ids, self.labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        groups = -(-row["dim"] // GROUP)
        self.planes = np.frombuffer(row["vectors"], np.uint8).reshape(row["planes"], groups, len(self.ids))


def _search(k: int, slots: int, same_label: bool):
    """Shards of a part come first and are held; then each tile of anchors is scored against all of them.

    Each anchor has ``slots`` lists; its limits hold a lowest and a highest score
    for each of them, or are missing where all scores count.
    """

    def of_tile(row: dict, shards: list[_Shard]) -> Iterator[pa.RecordBatch]:
        ids, labels = (np.frombuffer(row[c], "<i8") for c in ("ids", "labels"))
        vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dim"])
        limits = np.frombuffer(row["limits"], "<i8")
        limits = limits.reshape(len(ids), slots, 2) if len(limits) else None
        for at in range(0, len(ids), ANCHORS_AT_ONCE):
            some = slice(at, at + ANCHORS_AT_ONCE)
            own, n, tables = ids[some], len(ids[some]), {}
            best = _Best(n * slots, k)
            for shard in shards:
                kind = _narrowest(vectors[some], shard.planes)
                if kind not in tables:
                    tables[kind] = subset_sums(vectors[some].astype(kind))
                for first in range(0, len(shard.ids), ROWS_AT_ONCE):
                    rows = slice(first, first + ROWS_AT_ONCE)
                    scored = scores(tables[kind], shard.planes[:, :, rows])
                    here = shard.ids[rows]
                    fits = (shard.labels[rows, None] == labels[None, some]) == same_label
                    fits &= here[:, None] != own[None, :]
                    for slot in range(slots):
                        allowed = fits.copy()
                        if limits is not None:
                            allowed &= (scored >= limits[some, slot, 0]) & (scored <= limits[some, slot, 1])
                        best.add(np.arange(n) * slots + slot, here, scored, allowed)
            pair, i, s = best.rows()
            yield batch(_FOUND, own[pair // slots], pair % slots, i, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shards = None, {}
        for b in batches:
            for n in range(b.num_rows):
                row = {c: b.column(c)[n].as_py() for c in b.schema.names}
                if row["part"] != part:
                    part, shards = row["part"], {}
                if row["planes"]:
                    shards.setdefault(row["dim"], []).append(_Shard(row))
                elif row["dim"] in shards:
                    yield from of_tile(row, shards[row["dim"]])

    return run


def _best_of(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best of what the parts found, in two rounds."""
    order = [F.col("score").desc(), F.col("vec_id")]
    branch = Window.partitionBy(*keys, F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(*order)
    part = found.withColumn("rank", F.row_number().over(branch)).where(F.col("rank") <= k)
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _share(score: str, share: tuple[int, int], up: bool) -> str:
    """score * share as SQL, rounded up or down; for shares of up to 1 no product leaves the longs."""
    over, under = share
    rest = f"pmod({score}, {under}L) * {over}L" + (f" + {under - 1}L" if up else "")
    whole = f"({score} DIV {under}L - IF({score} % {under}L < 0, 1L, 0L))"
    return f"{whole} * {over}L + ({rest}) DIV {under}L"


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 10,
    least: tuple[int, int] = (30, 100),
    most: tuple[int, int] = (90, 100),
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    stage: Stage | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components count as floor(scale * x), within the range of a long; the score is
    their inner product, and longs wrap. An anchor's positives are its best rows
    of the same label, at most ``positives``; for each of them the best rows of
    another label whose score is from ``least`` to ``most`` of the positive's, as
    fractions, at most ``negatives``; ties go to the smaller id.

    Vectors are packed once into shards of bit planes. Each task holds the shards
    of its part, and every tile of anchors passes by it: a tile is copied once a
    part, a shard is not. Tables of subset sums exist for one tile's anchors at a
    time. A task returns its best rows of each anchor; they are merged in two
    rounds. No group of a label is ever brought together.

    Rows without an id, a label or a vector, or with a component that is missing or
    not finite, take no part. Vectors of different lengths do not meet. Rows that
    repeat an anchor's id are not its candidates; the smallest of them by vector
    and label is the anchor. Other repeated rows are candidates each. No anchor,
    positive or negative: no rows.
    """
    spark = vectors.sparkSession
    stage = stage or Stage(spark)
    rows = vectors.where(usable(vector_col) & col(id_col).isNotNull() & label.isNotNull())
    plain = [
        col(id_col).cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        col(vector_col).cast("array<double>").alias("vector"),
    ]
    whole = rows.select(*plain, F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("limits"))
    own = rows.where(is_anchor).select(*plain).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("own"))
    anchors = stage.table(own.select("id", "own.label", "own.vector"))

    packed = stage.table(arrow_map(whole, _pack(SHARD_ROWS, 1 << 20, scale, True), _SHAPE))
    size = packed.agg(F.sum(F.octet_length("vectors"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    shards = packed.withColumn("part", F.expr(f"part % {parts}"))

    def searched(asked: DataFrame, k: int, slots: int, same_label: bool) -> DataFrame:
        tiles = arrow_map(asked, _pack(TILE_ROWS, 1, scale, False), _SHAPE)
        copies = tiles.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        met = shards.unionByName(copies).repartition(parts, "part")
        met = met.sortWithinPartitions("part", F.col("planes").desc())
        return stage.table(
            arrow_map(met, _search(k, slots, same_label), "anchor_id bigint, slot int, vec_id bigint, score bigint")
        )

    asked = anchors.withColumn("limits", F.expr("CAST(array() AS ARRAY<BIGINT>)"))
    near = _best_of(searched(asked, positives, 1, True), ["anchor_id"], positives)
    near = stage.table(near.select("anchor_id", F.expr("rank - 1").alias("slot"), "vec_id", "score"))

    # an anchor without a list in a slot gets limits that no score meets
    lists = near.groupBy("anchor_id").agg(
        F.map_from_entries(
            F.collect_list(
                F.struct("slot", F.array(F.expr(_share("score", least, True)), F.expr(_share("score", most, False))))
            )
        ).alias("by_slot")
    )
    empty = "array(1L, 0L)"
    every = f"flatten(transform(sequence(0, {positives - 1}), s -> coalesce(by_slot[s], {empty})))"
    asked = anchors.join(lists, anchors.id == lists.anchor_id).select("id", "label", "vector", F.expr(every).alias("limits"))
    hard = _best_of(searched(asked, negatives, positives, False), ["anchor_id", "slot"], negatives)

    named = near.select("anchor_id", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return hard.join(named, ["anchor_id", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
