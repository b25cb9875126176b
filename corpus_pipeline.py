"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``. A document of which a stage takes all words stays as an
empty one; near-duplicate removal then keeps one of them.

What a stage has staged goes when the next one begins, whose input is written by
then: at any time the shared folder holds one stage's tables beside the results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import lines, packing, simhash, substring, toxicity
from tidemark.llm.shared import Stage

#: SQL can't express these stages; the tests hold them against brute force.
ORACLE_SQL = None


_stages: list[Stage] = []


def _stage(spark: SparkSession) -> Stage:
    """A place for the tables of one stage; those of the stage before go."""
    for earlier in _stages:
        if earlier.session is spark:
            earlier.drop()
    _stages[:] = [Stage(spark)]
    return _stages[0]


def _with_kept_text(found: DataFrame) -> DataFrame:
    """The rows with what is left of their texts, and its length where it changed."""
    changed = F.col("n_removed") > 0

    def shown(name: str):
        if name == "text":
            return F.col("kept").alias(name)
        own = F.col("row").getField(name)
        if name == "n_chars":
            own = F.when(changed, F.length("kept").cast("bigint")).otherwise(own)
        return own.alias(name)

    return found.select(*[shown(c) for c in found.schema["row"].dataType.names])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not find toxic."""
    classifier = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), stage=_stage(spark))
    return toxicity.scores(docs, classifier).where("score < 0.5").select("row.*")


def drop_similar_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one."""
    return _with_kept_text(lines.remove_similar_lines(docs, distance=None, digits=True, stage=_stage(spark)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal fingerprints."""
    found = simhash.simhash_components(docs, shingle=3, distance=3, stage=_stage(spark))
    return simhash.one_of_each(docs, found)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand in an earlier one."""
    return _with_kept_text(substring.remove_repeated(docs, window=50, stage=_stage(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 2048 tokens."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(docs, vocabulary, capacity=2048, end_id=0, stage=_stage(spark))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_similar_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again, the last but one goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    results: list[Stage] = []
    for name, apply in STAGES:
        result = Stage(spark)
        docs = result.table(apply(spark, docs, sf_dir), name)
        results.append(result)
        if len(results) > 1:
            results.pop(0).drop()
    return docs
