"""Near-duplicate documents: SimHash fingerprints linked through pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.hamming import Nearness, blocks_of, links_within
from tidemark.llm.shared import Stage, arrow_map, col, components, signed, text_or_empty, unbounded

SEED = 42
_LANES = np.uint64(0x0101010101010101)
_CHUNK = 60_000


class BitCounts:
    """How many of the added 64-bit numbers have each bit set."""

    def __init__(self) -> None:
        self.counts, self.n = np.zeros((8, 8), np.int64), 0

    def add(self, hashes: np.ndarray) -> None:
        self.n += len(hashes)
        rows = np.zeros(-(-max(len(hashes), 1) // 255) * 255, np.uint64)
        rows[: len(hashes)] = hashes
        rows = rows.reshape(-1, 255)
        for k in range(8):  # bit k of each of the eight bytes, counted in that byte
            lanes = ((rows >> np.uint64(k)) & _LANES).sum(axis=1, dtype=np.uint64)
            self.counts[k] += lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)

    def majority(self) -> int:
        """The number whose bits are those set in over half of what was added."""
        set_bits = 2 * self.counts.T.reshape(64) > self.n
        return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    counts = BitCounts()
    for at in range(0, len(words) - shingle + 1, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(shingle))))
        counts.add(np.fromiter(map(xxh64_intdigest, joined, repeat(SEED)), np.uint64, len(part) - shingle + 1))
    return counts.majority()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id, rk, fp``: a hash of every row's text, and its fingerprint as a signed long. No words: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [signed(fingerprint(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("rk"), pa.array(fps, pa.int64())], names=["id", "rk", "fp"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    rows = docs.select(col(id_col).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    return arrow_map(rows, run, f"id {kind}, rk bigint, fp bigint")


def ring_masks(distance: int) -> list[int]:
    """Bits on which two numbers within ``distance`` agree somewhere.

    64 bits are cut into ``distance + 1`` segments on a ring. By the pigeonring
    principle some segment starts a chain whose first l segments differ in
    l * distance / (distance + 1) bits at most, for every l: none in the first, one in
    the first two. So the first agrees, and one half of the second.
    """
    m = distance + 1
    segments = blocks_of(list(range(64)), m)
    masks = []
    for i, here in enumerate(segments):
        following = [b for b in range(64) if segments[(i + 1) % m] >> b & 1 and m > 1]
        masks += [here | half for half in blocks_of(following, 2)] if following else [here]
    return masks


def chain_test(distance: int):
    """numpy test: do the differing bits leave a chain within its budgets from some segment on?"""
    m = distance + 1
    segments = [np.uint64(s) for s in blocks_of(list(range(64)), m)]

    def keep(differ: np.ndarray) -> np.ndarray:
        each = [np.bitwise_count(differ & s).astype(np.int16) for s in segments]
        viable = np.zeros(len(differ), bool)
        for i in range(m):
            chain, total = np.ones(len(differ), bool), np.zeros(len(differ), np.int16)
            for length in range(1, m + 1):
                total = total + each[(i + length - 1) % m]
                chain &= total * m <= length * distance
            viable |= chain
        return viable

    return keep


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 3,
    distance: int = 3,
    stage: Stage | None = None,
) -> DataFrame:
    """``id, rk, fp, root, component_id`` for every row of ``docs``.

    Two rows are linked when their fingerprints differ in at most ``distance``
    bits; ``root`` is the smallest fingerprint and ``component_id`` the smallest id
    that a row reaches, itself included; ``rk`` is a hash of its text. Copies share a
    fingerprint and are compared once. Candidates share the bits of a pigeonring
    chain's start; the chain's further budgets are tested before the links count.

    Texts without words have fingerprint zero and are linked like any other.
    Missing ids are allowed (a component of nothing else has none); repeated rows
    stay as they are; an empty table gives none.
    """
    stage = stage or Stage(docs.sparkSession)
    rows = stage.table(fingerprints(docs, id_col, text_col, shingle))
    classes = stage.table(rows.groupBy("fp").agg(F.min("id").alias("least")))
    if distance < 1:
        named = classes.select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    else:
        numbers = classes.select("fp", F.col("fp").alias("node"))
        links = links_within(numbers, Nearness(distance, chain_test(distance)), ring_masks(distance), stage)
        roots = components(links, stage)
        rooted = classes.join(roots, classes.fp == roots.node, "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
        rooted = stage.table(rooted)
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = rooted.select("fp", "root").join(stage.table(least), "root").select("fp", "root", "component_id")
    return rows.join(stage.table(named), "fp").select("id", "rk", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each component, with its own columns; ``found`` is for these ``docs``.

    A component without any id keeps the row with the smallest hash of its text; of
    rows that repeat the kept one's id and text, one stays.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "rk")).alias("first")
    kept = found.groupBy("root").agg(first).select("first.id", "first.rk", F.col("first.last").alias("missing"))
    kind = docs.schema[id_col].dataType
    # plain keys, by which the rows are exchanged once for the join and for what repeats
    known = F.coalesce("id", F.lit("0").cast(kind))
    kept = kept.select(known.alias("known"), "missing", "rk")
    row = F.struct(*[col(c) for c in docs.columns])
    rows = docs.select(row.alias("row"), col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("rk"))
    rows = rows.select("row", known.alias("known"), F.col("id").isNull().alias("missing"), "rk")
    keys = ["known", "missing", "rk"]
    return rows.join(unbounded(kept), keys, "left_semi").dropDuplicates(keys).select("row.*")
