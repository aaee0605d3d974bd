"""Distinct by key, first wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key: the first by ``order``. An aggregate, so copies are combined before the shuffle."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct("*"), order).alias("_row")).select("_row.*")


def only_new(incoming: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier batch has not delivered."""
    return incoming.join(seen.select(key).distinct(), key, "left_anti")
