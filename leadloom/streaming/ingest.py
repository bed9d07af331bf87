"""Incremental ingest: candidates arrive in micro-batches, each is qualified and saved.

A batch saves only brands the store lacks, so a replayed batch (after a lost executor or driver) adds
nothing that is already there and completes what is missing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leadloom.operators.writes import new_prospects, only_cities_of, with_store_keys
from leadloom.sizing import checkpointed
from leadloom.sources.store import append_prospects, is_file, read_or_empty, table_exists

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def candidate_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they appear in a folder; a path to one file is that file of its folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, path):
        folder, _, name = path.rstrip("/").rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def save_batch(
    candidates: DataFrame, store_path: str, score: Callable[[DataFrame], DataFrame],
    order: Sequence[str | Column] = ("pos",), also_known: DataFrame | None = None, now=None,
) -> None:
    """Qualify one batch against the store and append what is new."""
    spark = candidates.sparkSession
    candidates = checkpointed(candidates)  # the batch is looked at twice and computed once
    existing = read_or_empty(spark, store_path).select("city", "domain")
    if also_known is not None:
        existing = existing.unionByName(also_known.select("city", "domain"))
    known = only_cities_of(existing, with_store_keys(candidates.select("city", "website_url")))
    append_prospects(score(new_prospects(candidates, known, order)), store_path, now)


def start_ingest(
    candidates: DataFrame, store_path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
    order: Sequence[str | Column] = ("pos",), also_known: DataFrame | None = None, now=None,
) -> StreamingQuery:
    """Run over everything available and stop; start again with the same checkpoint to go on."""

    def each(batch: DataFrame, _: int) -> None:
        save_batch(batch, store_path, score, order, also_known, now)

    return (
        candidates.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_stateful_ingest(
    candidates: DataFrame, store_path: str, checkpoint: str, score: Callable[[DataFrame], DataFrame],
    order: Sequence[str | Column] = ("pos",), also_known: DataFrame | None = None, now=None,
) -> StreamingQuery:
    """As :func:`start_ingest`, but the stream itself remembers which (city, domain) it has seen, in RocksDB.

    The stored keys are read once, when the checkpoint is new, and enter the first micro-batch as rows that come before
    any candidate. From then on a batch costs what it holds, however large the store has grown. Of a batch's
    candidates with one key the first by ``order`` is saved; a key seen in an earlier batch adds nothing. Only the
    first batch of a run may be one that was saved before and not committed, so only there the store is asked again.
    """
    spark = candidates.sparkSession
    known_path = f"{checkpoint.rstrip('/')}-known"
    if not table_exists(spark, f"{known_path}/_SUCCESS"):
        known = read_or_empty(spark, store_path).select("city", "domain")
        if also_known is not None:
            known = known.unionByName(also_known.select("city", "domain"))
        known.distinct().write.mode("overwrite").parquet(known_path)

    keyed = with_store_keys(candidates)
    names = keyed.columns
    turn = [(F.col(c) if isinstance(c, str) else c).alias(f"turn{k}") for k, c in enumerate(order)]
    fresh = keyed.select("city", "domain", F.struct(F.lit(True).alias("fresh"), *turn, F.struct(*names).alias("row")).alias("seen"))
    kind = fresh.schema["seen"].dataType
    stored = spark.readStream.schema("city string, domain string").parquet(known_path)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields[1:]]
    stored = stored.select("city", "domain", F.struct(F.lit(False).alias("fresh"), *nothing).alias("seen"))
    arrived = stored.unionByName(fresh).withColumn("at", F.current_timestamp())  # one moment per micro-batch
    first = arrived.groupBy("city", "domain").agg(F.min("seen").alias("first"), F.min("at").alias("at"))
    new = first.filter((F.col("at") == F.current_timestamp()) & F.col("first.fresh")).select("first.row.*")
    runs: list[int] = []

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.select(*names)
        if not runs:
            rows = checkpointed(rows)
            saved = only_cities_of(read_or_empty(spark, store_path).select("city", "domain"), rows)
            rows = rows.join(saved, ["city", "domain"], "left_anti")
        append_prospects(score(rows.select(*names)), store_path, now)
        runs.append(number)

    provider = spark.conf.get(STATE_PROVIDER, None)
    spark.conf.set(STATE_PROVIDER, ROCKS_DB)
    try:
        return (
            new.writeStream.foreachBatch(each).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
    finally:
        spark.conf.unset(STATE_PROVIDER) if provider is None else spark.conf.set(STATE_PROVIDER, provider)
