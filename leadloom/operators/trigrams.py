"""Substring search over stored prospects through trigram postings.

The rows are stored in blocks of near names, one folder each. A table of postings says for every three letters in a row of
a searched column in which blocks they occur. A search looks up the trigrams of its text, intersects the blocks of the
rarest ones, and reads only these blocks; the predicate itself then decides row by row, so the result is that of
a scan. Texts of less than three letters, or with ``%`` or ``_``, which stand for any letters, give no trigrams.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators.search import ProspectFilter, matching
from leadloom.sizing import bounded_broadcast

BLOCK_ROWS = 100_000
#: Trigrams of a text whose blocks are intersected.
RAREST = 4
#: Searched columns, and the criterion on each.
SEARCHED = {"name": "search_name", "country": "country", "most_similar_client": "similar_to_client"}


def store_indexed(prospects: DataFrame, path: str, block_rows: int = BLOCK_ROWS, searched: Sequence[str] = tuple(SEARCHED)) -> None:
    """Write rows and postings below ``path``. Blocks are ranges of lower-cased names, so that near names share them."""
    n = prospects.count()
    blocks = max(1, -(-n // block_rows))
    rows = prospects.repartitionByRange(blocks, F.lower("name"), "id").withColumn("block", F.spark_partition_id())
    folders = rows.write.partitionBy("block") if n else rows.write  # without rows there would be no file to tell the schema
    folders.parquet(f"{path}/rows")
    stored = prospects.sparkSession.read.parquet(f"{path}/rows")
    texts = stored.select("block", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.lower(F.col(c)).alias("text")) for c in searched
    ])).alias("x")).select("block", "x.*").filter(F.length("text") >= 3).distinct()
    letters = F.explode(F.sequence(F.lit(1), F.length("text") - 2))
    grams = texts.select("field", "block", "text", letters.alias("at"))
    grams = grams.select("field", "block", F.substr("text", "at", F.lit(3)).alias("gram")).distinct()
    grams.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram").write.parquet(f"{path}/postings")


def trigrams(text: str | None) -> list[str]:
    """The different trigrams of a searched text; none where only a scan can tell."""
    text = (text or "").lower()
    if len(text) < 3 or "%" in text or "_" in text:
        return []
    return sorted({text[k:k + 3] for k in range(len(text) - 2)})


def candidate_blocks(postings: DataFrame, field: str, text: str | None) -> DataFrame | None:
    """Blocks that hold the rarest trigrams of the text in a column; None if every block may match."""
    wanted = trigrams(text)
    if not wanted:
        return None
    held = postings.filter((F.col("field") == field) & F.col("gram").isin(wanted))
    counts = {r["gram"]: r["count"] for r in held.groupBy("gram").count().collect()}  # one row per trigram of the text
    rarest = sorted(wanted, key=lambda g: counts.get(g, 0))[:RAREST]
    return held.filter(F.col("gram").isin(rarest)).groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest)).select("block")


def indexed_matching(spark: SparkSession, path: str, f: ProspectFilter) -> DataFrame:
    """The rows that ``search.matching`` gives, from the blocks that can hold them."""
    rows, postings = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/postings")
    fields = {r["field"] for r in postings.select("field").distinct().collect()}  # at most as many as searched columns
    for column, criterion in SEARCHED.items():
        blocks = candidate_blocks(postings, column, getattr(f, criterion)) if column in fields else None
        if blocks is not None:
            rows = rows.join(bounded_broadcast(blocks), "block", "left_semi")
    return matching(rows, f).drop("block")
