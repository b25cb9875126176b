"""Token counts of whole texts: overlapping chunks, spliced at borders that hold in any text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_map, batch, col, slices, text_or_empty, unbounded

#: Characters of a chunk, and by how many two neighbours overlap at first.
CHUNK, OVERLAP = 1 << 13, 1 << 8
#: Texts of more bytes are dealt over tasks, in spans of about so many characters.
SPAN = 1 << 16

_MARK = "▁"  # what the vocabulary writes for a space


class _Chunk:
    """Tokens of ``text[begin:end]``; positions are those of the whole text."""

    def __init__(self, begin: int, end: int, shown: str, ends: np.ndarray):
        self.begin, self.end, self._shown, self._ends = begin, end, shown, ends

    def __len__(self) -> int:
        return len(self._ends)

    def tokens_before(self, at: int) -> int | None:
        """How many tokens end at or before ``at``; None if ``at`` lies within one."""
        want = len((_MARK + self._shown[: at - self.begin]).encode())
        n = int(np.searchsorted(self._ends, want, "right"))
        return n if n and self._ends[n - 1] == want else None


class Counter:
    """Counts tokens of a model of merged pieces.

    Two neighbouring characters that stand side by side in no piece are never
    merged, whatever surrounds them: a border between them is proven stable, and
    what lies left and right of it is encoded as if the other were not there. Chunks
    of a long text overlap; they are spliced at the first proven border of the
    overlap at which a token ends in both. Without one the left chunk and the
    overlap are widened, at the worst to the end of the text.
    """

    def __init__(self, path: str):
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self._widths = np.array(
            [1 if self._model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64
        )
        pairs = {a + b for p in pieces for a, b in zip(p, p[1:])}
        self._joined = np.sort(self._pair_codes(np.array([[ord(c) for c in p] for p in pairs], np.uint64)))
        # texts stand as they are but for the marks of spaces, and one in front
        probe = "  ﬁ½ ́é ＡＢ\t　a\r\n ​ "
        self.spliceable = self._model.normalize(probe) == _MARK + probe.replace(" ", _MARK)

    @staticmethod
    def _pair_codes(two: np.ndarray) -> np.ndarray:
        return two[:, 0] << np.uint64(21) | two[:, 1]

    def proven_borders(self, text: str, begin: int, end: int) -> np.ndarray:
        """Positions in ``begin < p < end`` whose two neighbours no piece holds side by side."""
        shown = text[begin:end].replace(" ", _MARK)
        points = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if len(points) < 2:
            return np.zeros(0, np.int64)
        codes = self._pair_codes(np.stack([points[:-1], points[1:]], 1))
        at = np.minimum(np.searchsorted(self._joined, codes), len(self._joined) - 1)
        return np.flatnonzero(self._joined[at] != codes) + begin + 1

    def _encode(self, text: str, begin: int, end: int) -> _Chunk | None:
        """The chunk with the offsets of its tokens; None if they don't add up to its text."""
        part = text[begin:end]
        shown = part.replace(" ", _MARK)
        ends = np.cumsum(self._widths[np.array(self._model.encode(part), np.int64)])
        whole = len(_MARK.encode()) + len(shown.encode())
        return _Chunk(begin, end, shown, ends) if len(ends) and ends[-1] == whole else None

    def count(self, text: str, since: int = 0) -> int:
        """Tokens of the text from ``since`` on, which is 0 or a proven border."""
        found = self._spliced(text, since) if self.spliceable and (since or len(text) > CHUNK + OVERLAP) else None
        if found is not None:
            return found
        if since:
            raise ValueError("the tokens of a span don't add up to its text")
        return len(self._model.encode(text))

    def _spliced(self, text: str, since: int) -> int | None:
        size, total = len(text), 0
        left = self._encode(text, 0, min(size, CHUNK + OVERLAP))
        while left is not None:
            skipped = left.tokens_before(since) if since else 0
            if skipped is None:
                return None
            overlap, found = OVERLAP, None
            while found is None and left.end < size:
                begin = max(left.end - overlap, since)
                right = self._encode(text, begin, min(size, begin + CHUNK + overlap))
                if right is None:
                    return None
                found = self._agreed(text, left, right)
                if found is None:
                    left = self._encode(text, left.begin, min(size, left.end + overlap))
                    overlap *= 2
                    if left is None:
                        return None
            if found is None:
                return total + len(left) - skipped
            total += left.tokens_before(found) - skipped
            left, since = right, found
        return None

    def _agreed(self, text: str, left: _Chunk, right: _Chunk) -> int | None:
        for at in self.proven_borders(text, right.begin, min(left.end, right.end)).tolist():
            if left.tokens_before(at) is not None and right.tokens_before(at) is not None:
                return at
        return None

    def spans(self, text: str) -> Iterator[tuple[int, str]]:
        """``lead, part``: parts whose tokens from ``lead`` on make up those of the text."""
        begin, size = 0, len(text)
        while begin < size:
            end, reach = min(size, begin + SPAN), OVERLAP
            while end < size:
                borders = self.proven_borders(text, end, min(size, end + reach)) if self.spliceable else []
                if len(borders) or end + reach >= size:
                    end = int(borders[0]) if len(borders) else size
                    break
                reach *= 2
            lead = min(begin, OVERLAP)
            yield lead, text[begin - lead : end]
            begin = end


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The model at ``path``, loaded once in a Python worker."""
    return Counter(path)


_SPANS = pa.schema([("digest", pa.binary()), ("span", pa.int64()), ("lead", pa.int64()), ("part", pa.string())])
_COUNTS = pa.schema([("digest", pa.binary()), ("span", pa.int64()), ("n", pa.int64())])


def _cut(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            digest = b.column("digest")[0].as_py()
            for k, (lead, part) in enumerate(counter(model).spans(b.column("text")[0].as_py())):
                yield batch(_SPANS, [digest], [k], [lead], [part])

    return run


def _count_spans(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 16):
            parts = zip(b.column("part").to_pylist(), b.column("lead").to_pylist())
            counts = [counter(model).count(part, lead) for part, lead in parts]
            yield batch(_COUNTS, b.column("digest"), b.column("span"), counts)

    return run


def _count_texts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = pa.array([counter(model).count(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), counts], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens`` for every row: bytes in UTF-8 and tokens of the whole text.

    ``model`` is a model file that every node can read; nothing is put before,
    after or in place of the text's own tokens. Texts of up to 64 KiB are counted
    where they are read. A longer one is cut at proven borders into spans, which
    are dealt evenly over the tasks; their counts are added up by the text's hash,
    so copies agree and only counts are joined. A missing or empty text has no
    tokens; rows without an id and repeated rows stay; an empty table gives none.
    """
    rows = docs.select(col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("bigint"))
    kind = docs.schema[id_col].dataType.simpleString()
    short = arrow_map(
        rows.where(F.col("n_bytes") <= SPAN), _count_texts(model), f"id {kind}, n_bytes bigint, n_tokens bigint"
    )

    digest = F.unhex(F.sha2("text", 256)).alias("digest")
    long = rows.where(F.col("n_bytes") > SPAN)
    spans = arrow_map(long.select(digest, "text"), _cut(model), "digest binary, span bigint, lead bigint, part string")
    counts = arrow_map(spans.hint("rebalance"), _count_spans(model), "digest binary, span bigint, n bigint")
    each = counts.groupBy("digest", "span").agg(F.max("n").alias("n"))  # once a text, however many rows hold it
    whole = each.groupBy("digest").agg(F.sum("n").alias("n_tokens"))
    sized = long.select("id", "n_bytes", digest)
    found = sized.join(unbounded(whole), "digest").select("id", "n_bytes", "n_tokens")
    return short.unionByName(found)
