"""The stored tables: Parquet, prospects partitioned by city.

Appends are ordinary Parquet appends. A change rewrites only the cities it touches; the new rows are
stored apart first, because the partitions to be replaced are also what was read.

Every file keeps a Bloom filter of its ids, written with the rows and so never out of date. A few ids are looked up by
equality, which reads only the row groups whose filter may hold them; what it lets through falsely is filtered by value.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions import keys
from leadloom.operators.common import top_per_key
from leadloom.operators.writes import delete_ids, only_cities_of, update_status, upsert, with_insert_defaults
from leadloom.schemas import PROSPECTS
from leadloom.sizing import checkpointed, stored


#: Parquet's own Bloom filter of the id column, as large as a file's ids need.
ID_FILTER = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
#: Ids up to which a change looks them up by equality; so many of a list are passed to the files as equalities by default.
FEW_IDS, IDS_TOGETHER = 200, 10
#: Ids that are looked at before a list is searched whole for so few different ones.
FIRST_IDS = 10_000

#: Folder name of rows without a city: a blank partition value would come back as null.
NO_CITY = "__no_city__"


def read_prospects(spark: SparkSession, path: str, schema: T.StructType = PROSPECTS) -> DataFrame:
    """The stored rows; those without a city have the blank one. Filters on the city still prune folders."""
    rows = spark.read.schema(schema).parquet(path)
    return rows.withColumn("city", F.when(F.col("city") == NO_CITY, "").otherwise(F.col("city")))


def _foldered(rows: DataFrame) -> DataFrame:
    blank = F.col("city").isNull() | (F.col("city") == "")
    return rows.withColumn("city", F.when(blank, NO_CITY).otherwise(F.col("city")))


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType = PROSPECTS) -> DataFrame:
    if table_exists(spark, path):
        return read_prospects(spark, path, schema)
    return spark.createDataFrame([], schema)


def conform(rows: DataFrame, schema: T.StructType = PROSPECTS) -> DataFrame:
    """Columns of the schema, cast; a score with decimals is cut to its integer part."""
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_prospects(rows: DataFrame, path: str, now=None) -> None:
    """Insert new rows with the table's defaults; a status that is given stays.

    Rows are rebalanced by city: small cities share a task and write one file each, and a city that holds
    a large part of the rows is split over many tasks by its actual size.
    """
    ready = _foldered(conform(with_insert_defaults(rows, now))).hint("rebalance", F.col("city"))
    ready.write.mode("append").options(**ID_FILTER).partitionBy("city").parquet(path)


def _rewrite(spark: SparkSession, path: str, rows: DataFrame, touched: DataFrame | None) -> None:
    """Replace the ``touched`` cities (default: those of ``rows``) by ``rows``; all others stay as they are.

    The rows are stored once, as their source is about to be overwritten. A touched city without rows
    loses its folder, since a rewrite replaces only folders that it has rows for.
    """
    kept = stored(rows)
    (
        _foldered(kept).hint("rebalance", F.col("city"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**ID_FILTER).partitionBy("city").parquet(path)
    )
    if touched is None:
        return
    _drop_folders(spark, path, touched.join(kept.select("city").distinct(), "city", "left_anti"))


def _drop_folders(spark: SparkSession, path: str, cities: DataFrame) -> None:
    """Delete the folders of the given cities. The table's folders are listed once; special characters are
    percent-coded in their names."""
    fs, root = _file_system(spark, path)
    folders = None
    for row in cities.toLocalIterator():
        if folders is None:
            folders = {}
            for status in fs.listStatus(root):
                folders.setdefault(unquote(status.getPath().getName()), []).append(status.getPath())
        for folder in folders.get(f"city={row['city'] or NO_CITY}", ()):
            fs.delete(folder, True)


def _of_cities(table: DataFrame, touched: DataFrame) -> DataFrame:
    """Rows of the touched cities; only their folders are read."""
    return only_cities_of(table, touched)


def replace_cities(rows: DataFrame, path: str) -> None:
    """Rewrite the partitions of the cities in ``rows``; all other cities stay untouched."""
    _rewrite(rows.sparkSession, path, rows, None)


def drop_cities(spark: SparkSession, path: str, cities: DataFrame) -> None:
    """Remove whole city partitions, named in any case and spacing: only folders are touched, no data is read."""
    named = cities.select(F.coalesce(keys.city_key("city"), F.lit("")).alias("city")).distinct()
    _drop_folders(spark, path, named)


def with_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored rows with one of the ids. A few ids reach the files, so that only row groups are read whose Bloom filter
    may hold them; more are joined."""
    known = ids.select("id").filter("id is not null")
    for some in (known.limit(FIRST_IDS), known):  # the first ones show most long lists for what they are
        few = sorted(r["id"] for r in some.distinct().limit(FEW_IDS + 1).collect())
        if len(few) > FEW_IDS:
            return table.join(ids.select("id"), "id", "left_semi")
    hit = F.lit(False)
    for at in range(0, len(few), IDS_TOGETHER):
        some = F.col("id").isin(few[at:at + IDS_TOGETHER])
        hit = some if not at else hit | some
    return table.filter(hit)


def _touched(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Cities that hold some of the ids."""
    return checkpointed(with_ids(table.select("id", "city"), ids).select("city").distinct())


def remove_ids(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete rows by id, rewriting only the cities they lie in."""
    table = read_prospects(spark, path)
    touched = _touched(table, ids)
    _rewrite(spark, path, delete_ids(_of_cities(table, touched), ids), touched)


def change_status(spark: SparkSession, path: str, changes: DataFrame, order: str = "change_no", now=None) -> None:
    """Apply status changes to the stored rows, rewriting only the cities they lie in."""
    table = read_prospects(spark, path)
    touched = _touched(table, changes)
    _rewrite(spark, path, conform(update_status(_of_cities(table, touched), changes, order, now)), touched)


def upsert_prospects(
    spark: SparkSession, path: str, incoming: DataFrame, overwrite: Sequence[str] = ("name", "website_url"), now=None
) -> None:
    """Insert rows with new ids; of known ids only the ``overwrite`` columns change, in the city they are stored in.

    Of rows that repeat an id the one that sorts first by all overwritten columns counts.
    """
    ready = conform(with_insert_defaults(incoming, now)).withColumn("city", F.coalesce(keys.city_key("city"), F.lit("")))
    ready = stored(top_per_key(ready, ["id"], [F.col(c) for c in overwrite]))  # read three times, mostly for ids and cities
    table = read_or_empty(spark, path)
    found = with_ids(table.select("id", F.col("city").alias("held_in")), ready)
    touched = ready.select("id", "city").join(found, "id", "left").select(F.coalesce("held_in", "city").alias("city"))
    touched = checkpointed(touched.distinct())
    _rewrite(spark, path, conform(upsert(_of_cities(table, touched), ready, "id", list(overwrite), now)), touched)


def append_log(rows: DataFrame, path: str) -> None:
    """Add lines to the outreach log."""
    rows.write.mode("append").parquet(path)
