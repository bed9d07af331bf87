"""Building blocks shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def top_per_key(
    df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], k: int = 1,
    rank_name: str | None = None,
) -> DataFrame:
    """The first ``k`` rows per key in a total order.

    ``row_number() <= k`` makes Spark put a ``WindowGroupLimit`` before the shuffle, so every map task
    sends at most ``k`` rows per key: a key that holds a third of the table costs ``k`` rows per task,
    not one huge task.
    """
    name = rank_name or _RANK
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
    return out if rank_name else out.drop(name)


def pg_order(column: str, descending: bool) -> Column:
    """Sort with nulls as the largest value: first when descending, last when ascending."""
    c = F.col(column)
    return c.desc_nulls_first() if descending else c.asc_nulls_last()
