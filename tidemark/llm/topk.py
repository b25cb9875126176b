"""Exact top-k search by inner product: tiles of queries against shards of all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import Stage, arrow_map, batch, col

#: A tile or shard holds so many bytes of vectors; scores are computed for so many at a time.
TILE_BYTES, SCORES_AT_ONCE = 2 << 20, 1 << 21

_PACKED = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


#: The doubles between which whole numbers are longs.
_LEAST, _MOST = -(2.0**63), 2.0**63 - 1024


def _whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x); what is no long is the nearest of these bounds."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(1024 * vectors), _LEAST, _MOST)


def _pack(parts: int):
    """Rows of (id, vector) as rows of whole matrices, by dimension."""

    def matrices(held: list, dim: int) -> pa.RecordBatch:
        ids = np.array([x[0] for x in held], "<i8")
        vectors = _whole(np.array([x[1] for x in held], "<f8").reshape(len(held), dim))
        part = int(ids[0] * 0x9E3779B1 >> 7) % parts
        return batch(_PACKED, [dim], [part], [ids.tobytes()], [vectors.tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for i, vector in zip(b.column("id").to_pylist(), b.column("vector")):
                values = vector.values.to_numpy(zero_copy_only=False)
                own = held.setdefault(len(values), [])
                own.append((i, values.astype("<f8")))
                if len(own) * 8 * max(len(values), 1) >= TILE_BYTES:
                    yield matrices(held.pop(len(values)), len(values))
        for dim, own in held.items():
            yield matrices(own, dim)

    return run


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits they wrap as long arithmetic does."""
    largest = np.abs(queries).max(initial=0.0) * np.abs(vectors).max(initial=0.0) * queries.shape[1]
    if largest < 2.0**53:  # every partial sum is a whole number that a double holds
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def _best(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row's (id, score) the k best: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, row))
    row = row[order]
    first = np.searchsorted(row, row, "left")
    order = order[np.arange(len(row)) - first < k]
    return order


def _search(k: int):
    def of_tile(queries, query_ids, vectors, ids) -> tuple[np.ndarray, ...]:
        kept = []
        step = max(1, SCORES_AT_ONCE // max(len(query_ids), 1))
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            scores = _products(queries, vectors[at : at + step])
            other = query_ids[:, None] != some[None, :]
            low = np.iinfo(np.int64).min
            shown = np.where(other, scores, low)
            if len(some) > k:  # partial selection: the k-th score bounds what can count
                bound = np.partition(shown, len(some) - k, axis=1)[:, len(some) - k]
                other &= shown >= bound[:, None]
            r, c = np.nonzero(other)
            kept.append((r, some[c], scores[r, c]))
        r, i, s = (np.concatenate([x[n] for x in kept]) for n in range(3))
        order = _best(r, i, s, k)
        return r[order], i[order], s[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, names, best = None, None, None

        def told():
            return batch(_FOUND, names[best[0]], best[1], best[2])

        for b in batches:
            for n in range(b.num_rows):
                dim = b.column("dim")[n].as_py()
                ids, query_ids = (np.frombuffer(b.column(c)[n].as_py(), "<i8") for c in ("ids", "query_ids"))
                vectors = np.frombuffer(b.column("vectors")[n].as_py(), "<f8").reshape(len(ids), dim)
                queries = np.frombuffer(b.column("queries")[n].as_py(), "<f8").reshape(len(query_ids), dim)
                here = b.column("tile")[n].as_py()
                if tile is not None and here != tile:
                    yield told()
                    best = None
                found = of_tile(queries, query_ids, vectors, ids)
                if best is not None:  # merge into the list of the tile, in this task
                    r, i, s = (np.concatenate(x) for x in zip(best, found))
                    order = _best(r, i, s, k)
                    found = r[order], i[order], s[order]
                tile, names, best = here, query_ids, found
        if tile is not None:
            yield told()

    return run


def usable(vector_col: str) -> Column:
    """The vector is there, and all of its components are finite numbers."""
    vector = col(vector_col)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    stage: Stage | None = None,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the k best of all other vectors.

    Components count as floor(1024 * x), at most the largest double that is a long and
    at least the smallest; the score is their inner product, in which longs wrap. Ties go
    to the smaller id. Queries and vectors are packed into matrices of a fixed
    size in bytes. Every tile of queries meets every shard in some task: a shard's
    row is repeated per tile, a tile's row per group of shards, so that the work
    is dealt evenly whatever the number of tiles. A task keeps k rows a query and
    tile; these lists are merged in a tree, groups of them first.

    Rows without an id, without a vector or with a component that is missing or
    not finite take no part. Vectors of different lengths do not meet. Each row
    with another id than the query's is a candidate, repeated ones included; of
    rows that repeat a query's id the smallest vector is the query. No query, or
    no candidate: no rows.
    """
    spark = vectors.sparkSession
    stage = stage or Stage(spark)
    rows = vectors.where(usable(vector_col) & col(id_col).isNotNull())
    whole = rows.select(col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("vector"))
    asked = rows.where(is_query).select(
        col(id_col).cast("bigint").alias("id"), col(vector_col).cast("array<double>").alias("vector")
    )
    asked = stage.table(asked.groupBy("id").agg(F.min("vector").alias("vector")))
    size = asked.agg(F.sum(8 * F.greatest(F.size("vector"), F.lit(1)))).first()[0] or 0
    tiles = max(1, -(-size // TILE_BYTES))

    shape = "dim int, part int, ids binary, vectors binary"
    tiled = stage.table(arrow_map(asked.repartition(tiles, "id"), _pack(1), shape))
    tiled = stage.table(tiled.withColumn("tile", F.monotonically_increasing_id()).drop("part"))
    # a few bytes for each tile of TILE_BYTES
    numbers = stage.table(tiled.groupBy("dim").agg(F.collect_list("tile").alias("tiles")))
    groups = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // tiles)

    shards = stage.table(arrow_map(whole, _pack(groups), shape))
    asked_tiles = tiled.selectExpr(
        "tile", "ids AS query_ids", "vectors AS queries", f"explode(sequence(0, {groups - 1})) AS part"
    )
    per_tile = shards.join(numbers, "dim").withColumn("tile", F.explode("tiles")).drop("tiles")
    met = per_tile.join(asked_tiles, ["tile", "part"])
    found = arrow_map(met.drop("part"), _search(k), "query_id bigint, vec_id bigint, score bigint")

    order = [F.col("score").desc(), F.col("vec_id")]
    found = stage.table(found)
    branch = Window.partitionBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(16))).orderBy(*order)
    top = Window.partitionBy("query_id").orderBy(*order)
    part = found.withColumn("rank", F.row_number().over(branch)).where(F.col("rank") <= k)
    best = part.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
