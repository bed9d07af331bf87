"""The k-th smallest composite key of a frame by distributed quickselect, and ranks of the rows up to it.

A round draws a few pivot keys at random among the rows still in question, and one job counts, for every pivot, the rows
below it and the rows equal to it. The counts are exact, so the rows in question shrink to those between two neighbouring
pivots, or the k-th key is a pivot. With PIVOTS pivots a round leaves about a PIVOTS-th of the rows: nine rounds for
10**10 rows. Only pivots and counts reach the driver. Nothing is sorted but the rows up to the k-th key, and those by a
range partitioning, never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.llm.common import checkpointed, unused_name

PIVOTS = 16
SEED = 7


def _key(columns: Sequence[str]) -> Column:
    """Nulls come last in every column."""
    return F.struct(*[x for c in columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _literal(df: DataFrame, columns: Sequence[str], row: Row) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[x for c, v in zip(columns, row) for x in (F.lit(v is None), F.lit(v).cast(types[c]))])


def kth(df: DataFrame, columns: Sequence[str], k: int, seed: int = SEED) -> tuple[Row, int]:
    """The k-th smallest key, from 1, and how many rows are smaller. ``df`` is read once or twice a round.

    Columns are compared in their order, ascending, nulls last. Fails if there are fewer than ``k`` rows.
    """
    key, inside, done = _key(columns), df.select(*[f"`{c}`" for c in columns]), 0
    turn = 0
    while True:
        turn += 1
        drawn = inside.orderBy(F.xxhash64(*[f"`{c}`" for c in columns], F.lit(seed * 1000 + turn))).limit(PIVOTS)
        pivots = sorted({tuple(r) for r in drawn.collect()}, key=lambda r: [(v is None, v) for v in r])
        if not pivots:
            raise ValueError(f"fewer than {k} rows")
        points = [_literal(df, columns, p) for p in pivots]
        counts = inside.agg(
            *[F.count_if(key < p).alias(f"less{i}") for i, p in enumerate(points)],
            *[F.count_if(key == p).alias(f"same{i}") for i, p in enumerate(points)],
        ).first()
        low, high = None, None
        for i, point in enumerate(points):
            less, same = done + counts[f"less{i}"], counts[f"same{i}"]
            if less < k <= less + same:
                return Row(*columns)(*pivots[i]), less
            if k <= less:
                high = point
                break
            low, upto = point, less + same
        if low is not None:
            inside, done = inside.filter(key > low), upto
        if high is not None:
            inside = inside.filter(key < high)


def least(df: DataFrame, columns: Sequence[str], k: int) -> Column:
    """A filter for the ``k`` rows of ``df`` with the smallest keys, which must be different."""
    if k <= 0:
        return F.lit(False)
    last, _ = kth(df, columns, k)
    return _key(columns) <= _literal(df, columns, last)


def numbered(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """All rows with their place, from 1, by the given columns; keys should be different.

    Rows are sorted in ranges. A row's place is its place in its range and the number of rows in ranges before, of which
    there are as many as shuffle partitions.
    """
    at, part = unused_name(df, "_at"), unused_name(df, "_part")
    rows = df.orderBy(*[F.col(f"`{c}`").asc_nulls_last() for c in columns])
    rows = checkpointed(rows.withColumn(at, F.monotonically_increasing_id()))
    parts = rows.groupBy(F.shiftright(at, 33).alias("part")).count().collect()
    before, ahead = [], 0
    for p in sorted(parts, key=lambda p: p["part"]):
        before.append((p["part"], ahead))
        ahead += p["count"]
    schema = T.StructType([T.StructField(part, T.LongType()), T.StructField("_ahead_of_part", T.LongType())])
    sizes = df.sparkSession.createDataFrame(before, schema)
    rows = rows.withColumn(part, F.shiftright(at, 33)).join(F.broadcast(sizes), part)
    place = F.col("_ahead_of_part") + F.col(at).bitwiseAND((1 << 33) - 1) + 1
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name))
