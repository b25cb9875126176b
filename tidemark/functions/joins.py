"""Join and reshape helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; keys come from ``left``.

    ``<=>`` still plans as a hash or sort-merge join, so large inputs are
    shuffled on the keys and adaptive execution can split skewed partitions.
    """
    matches = F.expr(" AND ".join(f"l.`{k}` <=> r.`{k}`" for k in keys))
    joined = left.alias("l").join(right.alias("r"), matches, how)
    if how == "left_semi":
        return joined
    return joined.select("l.*", *[f"r.`{c}`" for c in right.columns if c not in keys])


def to_long(
    df: DataFrame, ids: Sequence[str], concepts: Sequence[str], value: str, label: str = "concept"
) -> DataFrame:
    """Unpivot ``concepts`` into (label, value) rows, all values as doubles."""
    typed = df.selectExpr(*ids, *[f"CAST({c} AS DOUBLE) AS {c}" for c in concepts])
    return typed.unpivot(list(ids), list(concepts), label, value)
