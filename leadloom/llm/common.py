"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.sizing import bounded_broadcast, checkpointed

__all__ = [
    "HELD_OUT", "checkpointed", "held_out", "map_batches", "sampled_texts", "spans", "strings", "table", "text_groups", "unused_name", "with_columns_of",
]

#: Rows whose crc32(doc_id as text) mod 4 has this remainder are never learned from.
HELD_OUT = 2


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the wanted columns of one input table, so that extra columns are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def held_out(doc_id: Column | str) -> Column:
    """True for rows kept out of training. A null id counts as held out."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(4))
    return F.coalesce(remainder == HELD_OUT, F.lit(True))


def sampled_texts(documents: DataFrame, labelled: DataFrame, text: Column, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """(label, text) of at most ``per_label`` documents of each label, with whole texts.

    ``labelled`` has (id, label) of the rows that may be learned from. Ids are chosen by their hash before any
    text is read: a share that leaves about four times the wanted number per label, and of those the least. So
    what is shuffled does not grow with the corpus, only with the number of labels. Of rows that repeat an id the least
    text counts.
    """
    room = 1 << 30
    counts = labelled.groupBy("label").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), 4.0 * per_label / F.col("n")) * room
    few = labelled.join(bounded_broadcast(counts), "label").filter(F.pmod(F.xxhash64(id_col, F.lit(2)), F.lit(room)) < share)
    order = Window.partitionBy("label").orderBy(F.xxhash64(id_col), id_col)
    few = few.select("label", id_col).distinct().withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_label)
    few = bounded_broadcast(checkpointed(few.select("label", id_col)))
    texts = documents.select(id_col, text.alias("text")).filter("text is not null").join(few, id_col)
    return texts.groupBy(id_col, "label").agg(F.min("text").alias("text")).select("label", "text")


def strings(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


#: Bytes of texts that are Python strings at a time.
GROUP_BYTES = 2_000_000


def text_groups(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of successive parts of a text column of bounded size; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and total + size > GROUP_BYTES:
            yield start, strings(column.slice(start, k - start))
            start, total = k, 0
        total += size
    if start < len(column):
        yield start, strings(column.slice(start))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """Apply a function of one Arrow batch; batches are bounded in rows and bytes by Spark's settings.

    ``done`` is called when the task ends: idle Python workers live on and should hold no caches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                if batch.num_rows:
                    yield fn(batch)
        finally:
            if done is not None:
                done()

    return df.mapInArrow(run, schema)


def with_columns_of(
    df: DataFrame, text_col: str, keep: Sequence[str], fn: Callable[[pa.Array], list[pa.Array]], results: dict[str, str],
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """The kept columns of every row and columns made from one text column, batch by batch.

    The text travels once, also when it is among the kept columns. ``done`` is called when a task ends.
    """
    types = dict(df.dtypes)
    names = [*keep, *results]
    sent = [*keep] if text_col in keep else [*keep, text_col]
    at = sent.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], *fn(batch.column(at))], names=names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` {t}" for c, t in results.items())])
    return map_batches(df.select(*[F.col(f"`{c}`") for c in sent]), run, schema, done)


def unused_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every (start, length), one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
