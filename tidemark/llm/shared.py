"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidemark
from tidemark.staging import Staging

#: Words of the contracts, as a pattern for SQL functions; ``bytes.split()`` cuts at the same bytes.
SPACE = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stage(Staging):
    """Staged tables whose shuffle files are released as soon as they are written.

    Results returned by an operator read the staged tables, so the folder stays
    until ``drop`` or the end of the session.
    """

    def table(self, df: DataFrame, name: str | None = None) -> DataFrame:
        conf = self._spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            return super().table(df, name or uuid.uuid4().hex[:12])
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


    def within(self, build: Callable[[Stage], DataFrame]) -> DataFrame:
        """A staged table made of others, which go as soon as it is written."""
        inner = Stage(self._spark)
        try:
            return self.table(build(inner))
        finally:
            inner.drop()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once, which need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(tidemark.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="run-"), "tidemark.zip")
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def arrow_map(
    df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], shape: T.StructType | str
) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, shape)


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def text_or_empty(name: str) -> Column:
    return F.coalesce(col(name).cast("string"), F.lit(""))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def signed(x: int) -> int:
    """An unsigned 64-bit number as the long of the same bits."""
    return x - (1 << 64) if x >= 1 << 63 else x


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, where what is made of a row is large."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def unbounded(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: it is shuffled at every size, and never broadcast."""
    return df.hint("merge")


def null_safe_join(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str) -> DataFrame:
    """Join on two differently named columns; missing ids are equal."""
    return left.join(right, col(left_col).eqNullSafe(col(right_col)), how)


# --- connected components ----------------------------------------------------

EDGE = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])


class Forest:
    """Union-find over node numbers."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        nodes = [x for x in self.parent if self.find(x) != x]
        return nodes, [self.find(x) for x in nodes]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition, contracted: as many rows as nodes at most."""
    forest = Forest()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.join(x, y)
    nodes, roots = forest.stars()
    for at in range(0, len(nodes), 50_000):
        yield batch(EDGE, nodes[at : at + 50_000], roots[at : at + 50_000])


def components(links: DataFrame, stage: Stage, alone: int = 0) -> DataFrame:
    """``node, root`` for every linked node: the smallest node that it reaches, itself included.

    ``links`` holds two columns of node numbers. Edges are contracted within
    each partition, then rounds of large and small stars run until nothing
    changes; each round is staged, so a lost executor costs one round at most.
    A hub's edges meet only in joins, which Spark can split, and in minima,
    which are combined before the shuffle. Up to ``alone`` contracted edges, a number
    that does not grow with the input, are contracted in one task instead.
    """
    a, b = links.columns
    pairs = links.select(col(a).cast("bigint").alias("hi"), col(b).cast("bigint").alias("lo")).where("hi <> lo")

    def rooted(stars: DataFrame) -> DataFrame:
        roots = stars.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
        return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots)

    edges, seen = stage.table(arrow_map(pairs, _local_stars, "hi bigint, lo bigint")), None
    while True:
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if found == seen or found[0] == 0:
            return rooted(edges)
        if found[0] <= alone:
            return rooted(stage.table(arrow_map(edges.coalesce(1), _local_stars, "hi bigint, lo bigint")))
        seen = found
        near = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        least = stage.table(least)  # of known size, and a join of two plain tables is one that Spark can split
        large = near.join(least, "u").where("v > u").selectExpr("v AS hi", "m AS lo").distinct()
        large = stage.table(large)
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").selectExpr("lo AS hi", "m AS lo")
        edges = stage.table(moved.union(low.selectExpr("hi", "m AS lo")).distinct())
