"""The row that counts of every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Of every key the row with the largest ``order``: key and the named columns. Null keys are dropped; of equal orders the largest row counts.

    An aggregate and not a window: rows of a key that holds a third of the table meet before the shuffle.
    """
    last = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in columns])).alias("_r")
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(last).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
