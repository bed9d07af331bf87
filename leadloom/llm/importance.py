"""Resampling a corpus towards a target by importance weights of hashed word runs.

1. Every run of one or two words falls into one of ``BUCKETS`` buckets. Two jobs count the buckets of the corpus and of the
   target; each task adds up its own counts, so a task sends at most one row per bucket.
2. A bucket's gain is the log ratio of its smoothed shares. A document's weight is the floored mean gain of its runs, looked
   up in an array of gains.
3. A document's score is its weight and a Gumbel draw by its id, so the highest scores are a sample without replacement by
   weight. ``quickselect`` finds the last key drawn; only the drawn rows are sorted and ranked.

Null and empty texts have no words, weight 0, and are never drawn, as all texts of less than ``LEAST_WORDS`` words. Ties go to
the smaller id, null ids last. Rows that repeat an id draw alike but compete as rows of their own; among rows of equal score
and id those with fewer runs come first, and among rows that agree in these any are drawn. A null id is hashed as no digits.
Very long texts are counted whole. An empty corpus gives an empty result; an empty target has all its buckets at zero.
The result has the kept columns and the new ones; a kept column of a new one's name, in any letter case, is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.llm.common import checkpointed, text_groups, unused_name, with_columns_of
from leadloom.llm.quickselect import least, numbered
from leadloom.llm.word_buckets import text_buckets

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
RESULTS = ("n_features", "weight", "score", "rank")


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Runs per bucket over all texts, on the driver: ``buckets`` numbers whatever the size of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                total += np.bincount(text_buckets(texts, buckets)[2], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    rows = df.select(F.col(f"`{text_col}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus shares, with one run more in every bucket."""
    room = float(len(corpus))
    over = (target + 1.0) * (float(corpus.sum()) + room)
    under = (corpus + 1.0) * (float(target.sum()) + room)
    return np.floor(1000 * np.log(over / under)).astype(np.int64)


def weighted(
    df: DataFrame, gains: np.ndarray, text_col: str, keep: Sequence[str], names: tuple[str, str, str] = ("n_words", "n_features", "weight")
) -> DataFrame:
    """The kept columns of every row with its words, runs and weight."""

    def run(column: pa.Array) -> list[pa.Array]:
        made = []
        for _, texts in text_groups(column):
            words, owner, bucket = text_buckets(texts, len(gains))
            runs = np.bincount(owner, minlength=len(texts))
            total = np.bincount(owner, weights=gains[bucket], minlength=len(texts)).astype(np.int64)
            made.append((words, runs, total // np.maximum(runs, 1)))
        return [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*made)]

    return with_columns_of(df, text_col, keep, run, dict.fromkeys(names, "long"))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel draw by a hash of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    corpus: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",),
    percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """The kept columns of every row of ``corpus`` with runs, weight, score, and its rank if it was drawn."""
    if clash := {c.lower() for c in keep} & {*RESULTS}:
        raise ValueError(f"rename {sorted(clash)}")
    if id_col not in keep:
        raise ValueError(f"keep {id_col}")
    gains = bucket_gains(bucket_counts(corpus, text_col, buckets), bucket_counts(target, text_col, buckets))
    words, order, row = (unused_name(corpus, c) for c in ("_words", "_order", "_row"))
    scored = weighted(corpus, gains, text_col, keep, (words, "n_features", "weight"))
    scored = scored.withColumn("score", F.col("weight") + gumbel(F.col(f"`{id_col}`"), seed))
    scored = checkpointed(scored.withColumn(order, -F.col("score")).withColumn(row, F.monotonically_increasing_id()))
    fit = scored.filter(F.col(words) >= least_words)
    key = [order, id_col, "n_features", row]
    drawn = F.expr(f"`{words}` >= {least_words}") & least(fit, key, percent * fit.count() // 100)
    shown = [*keep, *RESULTS[:3]]
    winners = numbered(scored.filter(drawn), key, "rank").select(*[f"`{c}`" for c in shown], "rank")
    others = scored.filter(~drawn).select(*[f"`{c}`" for c in shown], F.lit(None).cast("long").alias("rank"))
    return winners.unionAll(others)
