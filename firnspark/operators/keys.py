"""Joins by keys that may be null."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet; the keys come back once."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # the other side is one row
    other = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__{k}" for k in keys])
