"""Measured size bounds for broadcast sides, and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 64 << 20


#: The optimizer's estimate is trusted this many times below the bound: files are compressed, rows are not.
ESTIMATE_FACTOR = 16


def _width(field: T.StructField) -> Column:
    """Bytes of a column's values, close enough for a bound; fixed-size elements are counted, not printed."""
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.octet_length(c)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(c) * 8
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.octet_length(F.to_json(F.struct(c)))
    return F.lit(8)


def is_small(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Whether a would-be broadcast side stays within the bounds.

    A plan whose estimated size is far below the bound is taken at its word without a job. Otherwise rows
    and widths are summed in every task, so that one small row per task is shuffled, never the rows.
    """
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate * ESTIMATE_FACTOR <= max_bytes:
        return True
    width = reduce(lambda a, b: a + b, [F.coalesce(_width(f), F.lit(0)).cast("bigint") for f in df.schema.fields])
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def bounded_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> DataFrame:
    """Hint a broadcast only for a side measured to be small.

    Beyond the bound the frame is returned as is: Spark then shuffles both sides on the join keys and
    splits skewed partitions at run time, so the result is the same.
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


#: Rows of a partition below which nothing is dealt anew.
FEW_ROWS = 2_000


def evenly_dealt(df: DataFrame) -> DataFrame:
    """For steps that take long per row: rows that lie in few partitions, as those of a file of one row group, are dealt to all cores.

    Rows are counted where they lie; where no partition has far more than its share, the frame is returned as is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    counts = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if counts[0] is None or counts[0] <= max(FEW_ROWS, 1.5 * counts[1] / cores):
        return df
    return df.repartition(max(4 * cores, df.rdd.getNumPartitions()))


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, below the cluster's shared ``spark.checkpoint.dir``.

    Only a local session, where every task runs on this machine, may fall back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="leadloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more, wherever it is stored."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but in columns: smaller, and later reads take only the columns that they need. What Parquet cannot
    hold is checkpointed."""
    names = [c.lower() for c in df.columns]
    kinds = df.schema.simpleString()
    if len(set(names)) < len(names) or "void" in kinds or "interval" in kinds or "variant" in kinds:
        return checkpointed(df)
    path = work_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
