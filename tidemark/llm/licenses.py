"""License scan: ordered signature rules behind a keyword filter, overlaps resolved."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.license_rules import Rule, load_rules
from tidemark.llm.shared import arrow_map, col, text_or_empty

#: Phrases whose every place counts, whatever the rules make of it: label, and a word of theirs that gates them.
BASE = {
    "under the mit license": ("mit", "mit"),
    "apache license version 2": ("apache-2", "apache"),
    "cc by nc": ("cc-by-nc", "cc"),
}
_WORDS = bytes.maketrans(
    bytes(range(128)), bytes(b if chr(b).isdigit() or chr(b).islower() else 32 for b in range(128))
)


@dataclass(frozen=True)
class Detection:
    """A rule's match: words ``start`` to ``end`` (not included)."""

    label: str
    start: int
    end: int
    score: float


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]
    detections: list[Detection]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(_WORDS).split()


class Scanner:
    def __init__(self, rules: list[Rule], base: dict[str, tuple[str, str]]):
        self.rules = rules
        self.base = [
            (re.compile(rf"(?<![^ ])(?={re.escape(phrase)}(?![^ ]))"), label, gate.encode())
            for phrase, (label, gate) in base.items()
        ]
        self.by_keyword: dict[bytes, list[int]] = {}
        for n, rule in enumerate(rules):
            for word in rule.keywords:
                self.by_keyword.setdefault(word.encode(), []).append(n)
        self.gates = frozenset(self.by_keyword) | {gate for _, _, gate in self.base}

    def scan(self, text: str | None) -> Scan:
        words = words_of(text)
        present = self.gates.intersection(words)
        if not present:
            return Scan(len(words), [], [])
        joined = b" ".join(words).decode("utf-8", "replace")
        base = [
            (joined.count(" ", 0, m.start()), label)
            for pattern, label, gate in self.base
            if gate in present
            for m in pattern.finditer(joined)
        ]
        found = []
        for n in sorted({n for word in present for n in self.by_keyword.get(word, ())}):
            rule = self.rules[n]
            for m in rule.pattern.finditer(joined):
                start = joined.count(" ", 0, m.start())
                found.append((n, Detection(rule.label, start, start + m[0].count(" ") + 1, rule.score)))
        return Scan(len(words), sorted(base), self._resolved(found))

    def _resolved(self, found: list[tuple[int, Detection]]) -> list[Detection]:
        """Drop what lies within a longer match, or within an equal one of a rule that comes first."""
        found.sort(key=lambda x: (x[1].start, -x[1].end, x[0]))
        kept: list[Detection] = []
        reach = -1
        for _, d in found:
            if d.end > reach:  # starts are in order, so nothing kept so far contains it
                kept.append(d)
                reach = d.end
        return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(load_rules(), BASE)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row, n_words, base, detections`` for every row: its own columns as a struct, and what was found.

    Words are lower-case letters, digits and whatever is not ASCII. ``base`` holds
    each place (``start``, ``label``) of a base phrase. ``detections`` (``label, start, end, score``)
    holds the matches of the signature rules that are left: a rule runs only on
    texts with one of its keywords, and a match goes when another contains it, or
    covers the same words by a rule of higher priority.

    Whole texts are scanned, each on its own, and nothing is shuffled. A missing or
    empty text has no words and no detections; repeated rows stay; an empty table
    gives none.
    """
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("label", T.StringType())])
    detection = T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    shape = T.StructType(
        [
            T.StructField("row", docs.schema),
            T.StructField("n_words", T.LongType()),
            T.StructField("base", T.ArrayType(place)),
            T.StructField("detections", T.ArrayType(detection)),
        ]
    )
    places = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    spans = pa.list_(
        pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner().scan
        for b in batches:
            found = [scan(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row"),
                    pa.array([x.n_words for x in found], pa.int64()),
                    pa.array([[{"start": s, "label": n} for s, n in x.base] for x in found], places),
                    pa.array([[vars(d) for d in x.detections] for x in found], spans),
                ],
                names=shape.names,
            )

    row = F.struct(*[col(c) for c in docs.columns])
    return arrow_map(docs.select(row.alias("row"), text_or_empty(text_col).alias("text")), run, shape)
