"""Byte-pair encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import arrow_map, col, slices, text_or_empty

#: A chunk ends where the rolling hash of the last WINDOW characters has its top CHUNK_BITS bits clear.
WINDOW, CHUNK_BITS = 8, 10
#: Chunks that a Python worker remembers before it starts afresh; a bound on memory, not on what is encoded.
CHUNKS_KEPT = 8_000

# Fixed value: how the vocabulary's pre-tokenizer splits a text.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space between two other characters: the splitting pattern never goes across its left side.
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def _byte_of_symbol() -> dict[str, int]:
    """Vocabulary files write each byte as a printable character: itself, or one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def boundaries(text: str) -> list[int]:
    """Offsets of the chunks' borders, the text's own ends included."""
    if len(text) <= WINDOW:
        return [0, len(text)]
    rolling = np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)
    rolling ^= rolling >> np.uint32(15)
    span = 1
    while span < WINDOW:  # hashes of twice as many characters, from two neighbouring ones
        rolling[span:] += rolling[:-span] * np.uint32(2 * span * 0x85EBCA6B % 2**32 | 1)
        span *= 2
    rolling *= np.uint32(0xC2B2AE35)
    cuts = np.flatnonzero(rolling < np.uint32(1 << (32 - CHUNK_BITS))) + 1
    return [0, *cuts[(cuts >= WINDOW) & (cuts < len(text))].tolist(), len(text)]


def _safe_from_end(text: str):
    """Safe places, the last first."""
    at = text.rfind(" ")
    while at > 0:
        if found := _SAFE.match(text, at):
            yield found
        at = text.rfind(" ", 0, at)


class Chunk:
    """Ids of a chunk on its own, and the part of them that holds in any text."""

    __slots__ = ("first", "last", "inner")

    def __init__(self, first: int, last: int, inner: np.ndarray | None):
        self.first, self.last, self.inner = first, last, inner


class Codec:
    """Encoder and decoder of one byte-level vocabulary.

    A text is cut into chunks where a rolling hash says so, so texts that share a
    passage share its chunks, and a chunk met again is not encoded again. What a
    chunk's ids are next to its border depends on the neighbour: there the span
    from the last safe place of the one to the first of the other is encoded anew,
    and is widened until it begins and ends on borders of both chunks' own ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, splitter = spec["model"]["vocab"], spec["pre_tokenizer"]
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        order = [vocab[word] for word in merged]
        plain = splitter["type"] == "ByteLevel" and not splitter["add_prefix_space"] and not spec["normalizer"]
        if order != sorted(order) or not plain:
            raise ValueError("a byte-level vocabulary whose ids follow the order of its merges is needed")
        symbols = _byte_of_symbol()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(map(symbols.__getitem__, word)): i for word, i in vocab.items() if word not in self.special}
        self._bpe = tiktoken.Encoding("vocabulary", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()} | {i: w.encode() for w, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._at_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        self._chunks: dict[str, Chunk] = {}

    # encoding

    def _alone(self, text: str) -> list[int]:
        """Ids of a piece of text, as if nothing stood beside it."""
        return self._bpe.encode_ordinary(text)

    def _chunk(self, text: str) -> Chunk:
        found = self._chunks.get(text)
        if found is None:
            if len(self._chunks) > CHUNKS_KEPT:
                self._chunks.clear()
            found = self._chunks[text] = self._inner(text, self._alone(text))
        return found

    def _inner(self, text: str, ids: list[int]) -> Chunk:
        """Cut off what a neighbour may change: up to a safe place that is a border of ids, at both ends."""
        first, head = self._agreed(text, ids, _SAFE.finditer(text))
        last, tail = self._agreed(text, ids, _safe_from_end(text), from_end=True)
        if first is None or last is None or last < first:
            return Chunk(-1, -1, None)
        return Chunk(first, last, np.array(ids[head : len(ids) - tail], np.uint32))

    def _agreed(self, text: str, ids: list[int], places, from_end: bool = False) -> tuple[int | None, int]:
        """The first of the places at which an id ends, and how many ids lie outside of it."""
        n, size = 0, 0
        for found in places:
            at = found.start()
            want = len((text[at:] if from_end else text[:at]).encode())
            while size < want:
                size += len(self._bytes[ids[-n - 1 if from_end else n]])
                n += 1
            if size == want:
                return at, n
        return None, 0

    def _part(self, text: str) -> list[np.ndarray]:
        borders, out, done = boundaries(text), [], 0
        for start, end in zip(borders, borders[1:]):
            chunk = self._chunk(text[start:end])
            if chunk.inner is not None:  # else the join reaches on into the next chunk
                out.append(np.array(self._alone(text[done : start + chunk.first]), np.uint32))
                out.append(chunk.inner)
                done = start + chunk.last
        out.append(np.array(self._alone(text[done:]), np.uint32))
        return out

    def encode(self, text: str | None, shared: bool = True) -> np.ndarray:
        """Ids of the whole text, with the ids of special tokens for their strings.

        Without ``shared`` it is encoded in one go, which texts that repeat little gain from.
        """
        parts = self._at_special.split(text or "") if self._at_special else [text or ""]
        found: list[np.ndarray] = []
        for k, part in enumerate(parts):
            if k % 2:
                found.append(np.array([self.special[part]], np.uint32))
            elif part and shared:
                found += self._part(part)
            elif part:
                found.append(np.array(self._alone(part), np.uint32))
        return np.concatenate(found) if found else np.zeros(0, np.uint32)

    # decoding

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids, special tokens included."""
        return b"".join(map(self._bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """The vocabulary at ``path``, loaded once in a Python worker."""
    return Codec(path)


# --- the operators ---------------------------------------------------------------


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids`` for every row: ids are little-endian unsigned 32-bit numbers.

    ``vocabulary`` is a tokenizer file that every node can read. Whole texts are
    encoded within their task, and nothing is shuffled; chunks are shared by the
    texts of a Python worker. A missing or empty text has no ids; rows without an
    id and repeated rows stay; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in slices(batches):
            ids = [bpe.encode(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id"),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                ],
                names=["id", "n_tokens", "ids"],
            )

    shape = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    return arrow_map(docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text")), run, shape)


def decode_ids(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """The rows of :func:`encode_texts` with their ``text`` again; missing ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for b in slices(batches):
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b.column("ids")]
            names = [*b.schema.names, "text"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return arrow_map(tokens, run, T.StructType([*tokens.schema.fields, T.StructField("text", T.StringType())]))
