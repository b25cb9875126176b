"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACE, Stage, col, null_safe_join, text_or_empty


def normalised(text_col: str) -> Column:
    """The text that is compared: each run of white space is one space; a missing text is empty."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    digest: bool = False,
    stage: Stage | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, full_hash``.

    Rows whose length no other row has are settled first, then those whose
    (length, prefix hash) is alone; both from one scan that keeps two numbers a
    row. Only rows of groups that are left get the hash of their full text
    (SHA-256), and equal hashes are a group. ``digest`` fills ``full_hash``
    for the settled rows too, which the refinement itself does not need.

    The smallest id of a group stays. Missing ids are allowed and come last;
    of rows with the same id and text exactly one is kept. A missing text counts
    as empty, an empty table gives none.
    """
    stage = stage or Stage(docs.sparkSession)
    text = normalised(text_col)
    sizes = stage.table(
        docs.select(
            col(id_col).alias("id"),
            F.length(text).alias("n"),
            F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"),
        )
    )
    lengths = sizes.groupBy("n").count().where("count > 1").select("n")
    same_length = stage.table(sizes.join(lengths, "n", "left_semi"))
    prefixes = same_length.groupBy("n", "prefix").count().where("count > 1").select("n", "prefix")
    same_prefix = same_length.join(stage.table(prefixes), ["n", "prefix"], "left_semi")
    open_ids = stage.table(same_prefix.select(F.col("id").alias("open_id")).distinct())

    texts = docs.select(col(id_col).alias("id"), text.alias("text"))
    flagged = null_safe_join(texts, open_ids.withColumn("open", F.lit(True)), "id", "open_id", "left")
    whole = F.sha2(F.col("text"), 256)
    full = F.when(F.col("open"), whole)
    hashed = stage.table(
        flagged.select("id", full.alias("full"), (F.coalesce(full, whole) if digest else full).alias("full_hash"))
    )
    groups = hashed.where("full IS NOT NULL").groupBy("full").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    copies = hashed.where("full IS NOT NULL").groupBy("id", "full").count()
    members = stage.table(copies).join(stage.table(groups), "full").select(
        "id",
        "keep_id",
        "group_size",
        F.expr("explode(sequence(1L, count))").alias("nth"),
        F.col("full").alias("full_hash"),
    )
    members = members.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1))
    alone = hashed.where("full IS NULL").selectExpr(
        "id", "id AS keep_id", "1L AS group_size", "true AS kept", "full_hash"
    )
    return members.select(*alone.columns).union(alone)
