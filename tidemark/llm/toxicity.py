"""Toxicity: non-negative positive-unlabelled learning of a linear classifier in numpy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import Stage, arrow_map, batch, col, ship, text_or_empty

#: Beginnings of words that are features besides the words themselves, so that inflected forms share one.
STEMS = (3, 4, 5, 6)
WORDS_KEPT = 200_000
_PLAIN = bytes.maketrans(bytes(range(128)), bytes(b if chr(b).isalnum() else 32 for b in range(128)))


@dataclass(frozen=True)
class Training:
    """Bounds and parameters of the fit; scoring covers every row, whatever these are."""

    max_positive: int = 6_000
    max_unlabelled: int = 18_000
    max_features: int = 50_000
    least_count: int = 5
    least_z: float = 4.5
    rounds: int = 300
    rate: float = 0.05
    shrink: float = 0.1


def words_of(text: str | None) -> set[str]:
    return {w.decode() for w in (text or "").lower().encode().translate(_PLAIN).split()}


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked as such."""
    return [word, *(word[:n] + "-" for n in STEMS if len(word) > n)]


# --- learning --------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_nnpu(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], size: int, prior: float, how: Training
) -> tuple[np.ndarray, float]:
    """Weights and bias over binary features, given by their numbers for each text.

    The risk is prior * E+[l(+)] + max(0, Eu[l(-)] - prior * E+[l(-)]) with the logistic
    loss. Unlabelled texts count as negative, less what the positive ones among
    them add. When that difference falls below zero, the step is the other way.
    """

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(r) for r in rows], np.int64)
        return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), n, np.repeat(np.arange(len(rows)), n)

    (ip, np_, rp), (iu, nu, ru) = flat(positive), flat(unlabelled)
    weights, bias = np.zeros(size), 0.0
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, how.rounds + 1):
        sp = np.bincount(rp, weights[ip], len(positive)) + bias
        su = np.bincount(ru, weights[iu], len(unlabelled)) + bias
        negative = np.logaddexp(0, su).mean() - prior * np.logaddexp(0, sp).mean()
        as_negative_p = -prior * _sigmoid(sp) / len(sp)
        as_negative_u = _sigmoid(su) / len(su)
        if negative >= 0:
            gp, gu = -prior * _sigmoid(-sp) / len(sp) + as_negative_p, as_negative_u
        else:
            gp, gu = -as_negative_p, -as_negative_u
        slope = np.bincount(ip, np.repeat(gp, np_), size) + np.bincount(iu, np.repeat(gu, nu), size)
        slope = np.append(slope + how.shrink / (len(sp) + 100) * weights, gp.sum() + gu.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope * slope
        move = how.rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


@dataclass
class Classifier:
    """A linear score over words and their beginnings; without any weights it tells nothing toxic."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -30.0
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, texts: pd.Series) -> pd.Series:
        known, weights, scores = self._known, self.weights, np.zeros(len(texts))
        for n, text in enumerate(texts):
            found: set[str] = set()
            for word in words_of(text):
                own = known.get(word)
                if own is None:
                    if len(known) > WORDS_KEPT:
                        known.clear()
                    own = known[word] = tuple(f for f in features_of(word) if f in weights)
                if own:
                    found.update(own)
            scores[n] = self.bias + sum(weights[f] for f in sorted(found))
        return pd.Series(_sigmoid(scores))


def held_out(id_col: str) -> Column:
    """Rows whose labels no fit may see."""
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled texts of a partition each feature occurs."""
    schema = pa.schema([("feature", pa.string()), ("p", pa.int64()), ("u", pa.int64())])
    counts = Counter(), Counter()
    for b in batches:
        for text, positive in zip(b.column("text").to_pylist(), b.column("positive").to_pylist()):
            counts[0 if positive else 1].update({f for w in words_of(text) for f in features_of(w)})
    names = [*(counts[0].keys() | counts[1].keys())]
    for at in range(0, len(names), 50_000):
        some = names[at : at + 50_000]
        yield batch(schema, some, [counts[0][f] for f in some], [counts[1][f] for f in some])


def _numbered(features: dict[str, int]):
    schema = pa.schema([("positive", pa.bool_()), ("found", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                sorted({features[f] for w in words_of(t) for f in features_of(w) if f in features})
                for t in b.column("text").to_pylist()
            ]
            yield batch(schema, b.column("positive").to_pylist(), found)

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    how: Training | None = None,
    stage: Stage | None = None,
) -> Classifier:
    """A classifier from confirmed toxic texts and texts of unknown kind.

    Labels are read for rows that are not :func:`held_out`. Positive texts are those
    labelled 1, unlabelled ones any texts, without a look at their label; of both,
    at most ``max_positive`` and ``max_unlabelled`` rows with the smallest hashes of
    their ids. The share of 1 among the labels is the class prior. Features are
    words and word beginnings that occur more or less often in positive texts than
    in unlabelled ones by ``least_z`` standard errors. Of several labels of a row the
    largest counts; with no positive text that is there, nothing is toxic.
    """
    how = how or Training()
    stage = stage or Stage(docs.sparkSession)
    order = F.xxhash64("id")
    marked = labels.where(~held_out(id_col) & col(label_col).isNotNull())
    marked = marked.groupBy(col(id_col).alias("id")).agg(F.max(col(label_col)).alias("label"))
    prior = marked.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    if not prior:
        return Classifier()
    rows = docs.where(~held_out(id_col) & col(id_col).isNotNull()).select(
        col(id_col).alias("id"), text_or_empty(text_col).alias("text")
    )
    # as many ids as the bound says, so small enough to broadcast
    toxic = stage.table(marked.where("label = 1").orderBy(order, "id").limit(how.max_positive).select("id"))
    last = rows.select(order.alias("h")).orderBy("h").limit(how.max_unlabelled).agg(F.max("h")).first()[0]
    positive = rows.join(F.broadcast(toxic), "id").select("text", F.lit(True).alias("positive"))
    unlabelled = rows.where(order <= F.lit(last)).select("text", F.lit(False).alias("positive"))
    sample = stage.table(positive.union(unlabelled))
    n = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    if not n.get(True) or not n.get(False):
        return Classifier()

    counted = arrow_map(sample, _counts, "feature string, p bigint, u bigint")
    counted = counted.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = f"(p + u + 1) / {n[True] + n[False]}"
    z = F.expr(f"abs(p / {n[True]} - u / {n[False]}) / sqrt({rate} * {1 / n[True] + 1 / n[False]!r}D)")
    chosen = counted.where(F.col("p") + F.col("u") >= how.least_count).withColumn("z", z)
    chosen = chosen.where(F.col("z") > how.least_z).orderBy(F.desc("z"), "feature").limit(how.max_features)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    features = {f: i for i, f in enumerate(names)}

    texts = arrow_map(sample, _numbered(features), "positive boolean, found array<int>").toArrow()
    found = [np.array(x, np.int64) for x in texts.column("found").to_pylist()]
    kinds = texts.column("positive").to_pylist()
    order_of = sorted(range(len(found)), key=lambda i: (kinds[i], found[i].tolist()))  # as fitted whatever the row order
    weights, bias = fit_nnpu(
        [found[i] for i in order_of if kinds[i]],
        [found[i] for i in order_of if not kinds[i]],
        len(names),
        float(prior),
        how,
    )
    return Classifier(dict(zip(names, weights.tolist())), float(bias))


def scores(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """``row, score`` for every row: its own columns as a struct, and 0 to 1 for its whole text.

    Missing and empty texts get the score of a text without known words; repeated
    rows stay; an empty table gives none. Only the text is looked at.
    """
    ship(docs.sparkSession)

    @F.pandas_udf(T.DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield classifier.score(some)

    row = F.struct(*[col(c) for c in docs.columns])
    return docs.select(row.alias("row"), score(text_or_empty(text_col)).alias("score"))
