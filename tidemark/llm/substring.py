"""Passages that repeat across documents, found by level-wise doubling of word windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_intdigest, xxh64_intdigest

from tidemark.llm.shared import Stage, arrow_map, batch, col, signed, text_or_empty, unbounded

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Words whose hashes are in memory at a time; longer texts go block by block.
BLOCK = 200_000


# --- windows of one text -------------------------------------------------------


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base)])
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse)])
        return self.up, self.down


_POWERS = tuple(_Powers(b) for b in _BASES)


def window_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A hash of every ``length`` consecutive word hashes."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    up, down = _POWERS[which].to(len(words) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * up[: len(words)])]
    x = (sums[length:] - sums[:-length]) * down[: len(words) - length + 1]
    x ^= x >> np.uint64(31)  # spread, so that the smallest hash is a fair choice
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(x) - width + 1
    return np.minimum(least[:n], least[width - span : width - span + n])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words, repeat(0)), np.uint64, len(words))


def blocks(words: list[bytes], window: int) -> Iterator[tuple[int, np.ndarray]]:
    """Start and word hashes of blocks that overlap by a window less one word."""
    for at in range(0, max(len(words) - window + 1, 0), BLOCK):
        yield at, word_hashes(words[at : at + BLOCK + window - 1])


def signatures(hashes: np.ndarray, half: int, window: int) -> np.ndarray:
    """Of each window, the smallest hash of the half-length windows within: equal windows have the same."""
    return sliding_min(window_hashes(hashes, half), window - half + 1)


# --- passes over the texts -----------------------------------------------------


def _first_pass(half: int, window: int):
    schema = pa.schema([*((n, pa.int64()) for n in ("id", "rk", "s1", "s2")), ("halves", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, keep, ends = [], [], []
            for i, text in enumerate(b.column("text")):
                words = text.as_py().encode().split()
                if len(words) < window:
                    continue
                parts = [np.unique(signatures(h, half, window)) for _, h in blocks(words, window)]
                found.append(np.unique(np.concatenate(parts)).view(np.int64))
                whole = xxh3_128_intdigest(b" ".join(words))
                ends.append((signed(whole >> 64), signed(whole & (2**64 - 1))))
                keep.append(i)
            if not keep:
                continue
            at = pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32())
            halves = pa.ListArray.from_arrays(at, pa.array(np.concatenate(found)))
            s1, s2 = zip(*ends)
            rows = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), rows.column("rk"), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), halves],
                schema=schema,
            )

    return run


def _extend(half: int, window: int):
    """Windows whose half-length part repeats, at twice that length."""
    schema = pa.schema(
        [("a", pa.int64()), ("b", pa.int32()), ("id", pa.int64()), ("rk", pa.int64()), ("start", pa.int32())]
    )

    def flush(held: list[tuple]) -> pa.RecordBatch:
        n = [len(x[0]) for x in held]
        a, c, start = (np.concatenate([x[k] for x in held]) for k in range(3))
        ids, keys = (np.repeat(np.array([x[k] for x in held], np.int64), n) for k in (3, 4))
        return batch(schema, a, c, ids, keys, start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            ids, keys = b.column("id").to_pylist(), b.column("rk").to_pylist()
            for i in range(b.num_rows):
                words = b.column("text")[i].as_py().encode().split()
                marks = np.unique(b.column("marks")[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                for at, h in blocks(words, window):
                    least = signatures(h, half, window)
                    place = np.minimum(np.searchsorted(marks, least), len(marks) - 1)
                    start = np.flatnonzero(marks[place] == least)
                    a = window_hashes(h, window)[start].view(np.int64)
                    c = window_hashes(h, window, 1)[start].astype(np.uint32).view(np.int32)
                    held.append((a, c, (start + at).astype(np.int32), ids[i], keys[i]))
                    size += len(start)
                    if size >= 50_000:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    return run


def _covered(starts: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` words the windows cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def without_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text less some of its words; what stood between two kept words stays, once."""
    out, last, cut = [], 0, False
    for word, drop in zip(_WORD.finditer(text), gone):
        if drop:
            if not cut:
                out.append(text[last : word.start()])
            cut = True
        else:
            if cut:
                last = word.start()
            cut = False
        if drop:
            last = word.end()
    if not cut:
        out.append(text[last:])
    return b"".join(out)


def _cut(window: int, names: list[str]):
    """Texts less their covered words; the other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, total, removed = [], [], []
            for text, copy, starts in zip(b.column("text"), b.column("copy"), b.column("starts")):
                raw = text.as_py()
                words = len((raw or "").encode().split())
                gone = 0
                if copy.as_py():
                    raw, gone = "", words
                elif starts.is_valid:
                    mask = _covered(starts.values.to_numpy(zero_copy_only=False).astype(np.int64), window, words)
                    raw, gone = without_words(raw.encode(), mask).decode(), int(mask.sum())
                texts.append(raw)
                total.append(words)
                removed.append(gone)
            kept = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), kept, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=names
            )

    return run


# --- the operator --------------------------------------------------------------


def remove_repeated(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 50,
    stage: Stage | None = None,
) -> DataFrame:
    """``row, kept, n_words, n_removed`` for every row of ``docs``.

    ``row`` is a struct of the row's own columns. ``kept`` is its text less each
    word covered by a window of ``window`` (even) words that also starts in a
    document with a smaller id; a text of which nothing goes is returned as it is.

    Windows of half the length come first. Of a full window's halves only that
    with the smallest hash is looked up, which equal windows share, so a small
    part of all positions is shuffled. Windows whose half repeats in another
    document are extended to twice the length and looked up again; when none
    repeats, that is the end. Lengths above ``window`` need no look: their
    windows are covered by those of ``window`` words.

    Copies of a whole word sequence are settled first, by a hash of it. Missing
    texts are empty. A row without an id keeps its words and takes nothing from
    others; rows with equal ids take nothing from each other; an empty table
    gives none.
    """
    stage = stage or Stage(docs.sparkSession)
    half = window // 2
    row = F.struct(*[col(c) for c in docs.columns])
    rows = docs.select(
        row.alias("row"),
        col(id_col).cast("bigint").alias("id"),
        F.xxhash64(text_or_empty(text_col)).alias("rk"),
        col(text_col).cast("string").alias("text"),
    )
    texts = rows.select("id", "rk", F.coalesce("text", F.lit("")).alias("text")).where("id IS NOT NULL")

    first = stage.table(
        arrow_map(
            texts, _first_pass(half, window), "id bigint, rk bigint, s1 bigint, s2 bigint, halves array<bigint>"
        )
    )
    leads = stage.table(first.groupBy("s1", "s2").agg(F.min("id").alias("lead"), F.max("id").alias("last")))
    copies = first.select("id", "rk", "s1", "s2").join(leads.where("lead < last"), ["s1", "s2"]).where("id > lead")
    copies = stage.table(copies.select("id", "rk").distinct())

    own = first.join(copies, ["id", "rk"], "left_anti").select("id", "rk", F.explode("halves").alias("h"))
    own = stage.table(own)
    repeated = own.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
    marked = own.join(stage.table(repeated), "h", "left_semi").groupBy("id", "rk")
    marks = stage.table(marked.agg(F.collect_set("h").alias("marks")))

    longer = stage.table(
        arrow_map(
            texts.join(unbounded(marks), ["id", "rk"]), _extend(half, window), "a bigint, b int, id bigint, rk bigint, start int"
        )
    )
    shared = longer.groupBy("a", "b").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    hits = longer.join(stage.table(shared.select("a", "b", "lo")), ["a", "b"]).where("id > lo")
    hits = hits.groupBy("id", "rk").agg(F.collect_set("start").alias("starts"))
    told = stage.table(
        hits.select("id", "rk", F.lit(False).alias("copy"), "starts").unionByName(
            copies.select("id", "rk", F.lit(True).alias("copy"), F.lit(None).cast("array<int>").alias("starts"))
        )
    )
    shape = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("kept", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
        ]
    )
    return arrow_map(rows.join(unbounded(told), ["id", "rk"], "left"), _cut(window, shape.names), shape)
