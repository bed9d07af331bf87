"""Exact quantiles of any number of groups by distributed selection.

Values become 64-bit codes in the same order. A pass counts, per group and wanted rank, the rows by the next few bits of their
code among those that agree in the bits known so far; the counts say which bits the wanted value has. So a pass sends at
most ``2 ** DIGIT`` counts per rank, whatever the number of distinct values, and six passes settle all 64 bits; bits that
no group differs in are skipped. ``percentile`` in place of this keeps every distinct value of a group in one buffer.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.sizing import bounded_broadcast, checkpointed

DIGIT = 11
LOWEST = -(1 << 63)


def _recoded(df: DataFrame, column: str, decode: bool) -> DataFrame:
    """Doubles as whole numbers in the same order (not a number is the largest), or back."""

    def flip(bits: np.ndarray) -> np.ndarray:
        return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            x = b.column(at).to_numpy(zero_copy_only=False)
            if decode:
                new = flip(x.astype(np.int64)).view(np.float64)
            else:
                x = x.astype(np.float64) + 0.0  # one zero
                new = flip(np.where(np.isnan(x), np.nan, x).view(np.int64))
            columns = [pa.array(new) if k == at else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    kind = T.DoubleType() if decode else T.LongType()
    return df.mapInArrow(run, T.StructType([T.StructField(f.name, kind if f.name == column else f.dataType) for f in df.schema.fields]))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], *more: Column, how: str = "inner") -> DataFrame:
    """Join on equal keys, where nulls are equal too; the keys of the left side stay."""
    renamed = right
    for k, c in enumerate(keys):
        renamed = renamed.withColumnRenamed(c, f"_k{k}")
    on = [F.col(c).eqNullSafe(F.col(f"_k{k}")) for k, c in enumerate(keys)]
    return left.join(renamed, [*on, *more], how).drop(*[f"_k{k}" for k in range(len(keys))])


def _bits(c: Column, down: int) -> Column:
    """The upper bits of a code, as an unsigned number."""
    return F.shiftrightunsigned(c, down) if down < 64 else F.lit(0).cast("long")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """One row per group with one column per named share, between neighbouring values as ``percentile`` has it.

    Null values do not count; a group without values has nulls. Without keys there is one row, also for an empty
    frame. Whole numbers up to 2**53, and doubles with infinities and one not-a-number above them, are exact.
    """
    keys = list(keys)
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(1))
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    rows = rows.select(*by, F.col(value).cast("long" if whole else "double").alias("code"))
    groups = checkpointed(rows.groupBy(*by).agg(F.count("code").alias("n")))
    coded = rows.filter("code is not null")
    coded = coded if whole else _recoded(coded, "code", decode=False)
    coded = checkpointed(coded.withColumn("code", F.col("code").bitwiseXOR(F.lit(LOWEST))))  # unsigned order

    wanted = []
    for name, share in shares.items():
        at = (F.col("n") - 1) * F.lit(float(share))
        wanted += [
            F.struct(F.lit(name).alias("name"), F.lit(high).alias("high"), round_(at).cast("long").alias("rank"))
            for high, round_ in ((False, F.floor), (True, F.ceil))
        ]
    spans = coded.groupBy(*by).agg(F.min("code").alias("any"), F.bit_and("code").alias("ones"), F.bit_or("code").alias("some"))
    spans = checkpointed(spans)
    differing = spans.agg(F.bit_or(F.col("ones").bitwiseXOR(F.col("some")))).first()[0] or 0
    open_bits = 64 if differing < 0 else differing.bit_length()
    state = _same(groups.filter("n > 0"), spans, by).select(*by, F.explode(F.array(*wanted)).alias("w"), "any")
    state = state.select(*by, "w.*", _bits(F.col("any"), open_bits).alias("known"))
    while open_bits:
        width = min(DIGIT, open_bits)
        state = bounded_broadcast(checkpointed(state))
        fits = _bits(F.col("code"), open_bits) == F.col("known")
        counts = _same(coded, state, by, fits).withColumn("digit", _bits(F.col("code"), open_bits - width).bitwiseAND((1 << width) - 1))
        each = [*by, "name", "high", "rank", "known"]
        counts = counts.groupBy(*each, "digit").agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.partitionBy(*by, "name", "high").orderBy("digit"))
        found = counts.withColumn("upto", upto).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = found.select(
            *by, "name", "high", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"),
            F.shiftleft("known", width).bitwiseOR(F.col("digit")).alias("known"),
        )
        open_bits -= width
    found = state.select(*by, "name", "high", F.col("known").bitwiseXOR(F.lit(LOWEST)).alias("x"))
    found = found.withColumn("x", F.col("x").cast("double")) if whole else _recoded(found, "x", decode=True)
    low, high = (F.max(F.when(F.col("high") == h, F.col("x"))) for h in (False, True))
    pairs = found.groupBy(*by, "name").agg(low.alias("low"), high.alias("up"))
    pairs = pairs.groupBy(*by).agg(*[
        F.max(F.when(F.col("name") == name, F.struct("low", "up"))).alias(f"_{name}") for name in shares
    ])
    out = _same(groups, pairs, by, how="left")
    if not keys:
        out = df.sparkSession.range(1).select(F.lit(1).alias("_one")).join(out, F.col("_one") == F.col("_all"), "left")
    columns = []
    for name, share in shares.items():
        at, pair = (F.col("n") - 1) * F.lit(float(share)), F.col(f"_{name}")
        over = at - F.floor(at)
        between = (1 - over) * pair["low"] + over * pair["up"]
        columns.append(F.when(over == 0, pair["low"]).when(pair["low"] == pair["up"], pair["low"]).otherwise(between).alias(name))
    return out.select(*keys, *columns)
