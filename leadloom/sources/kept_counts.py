"""Statistics of the stored prospects that are kept up to date instead of being recomputed.

Kept are counts per (city, status, score): partial states that add up. A batch adds its rows' counts, and a change withdraws
the counts of the rows it touched and adds those of what became of them. Totals, bands and means follow from the counts, and
so does a maximum, as the highest score that still has a count, which a running maximum could not give after a removal.

Rows and counts are two writes. Before a change the cities it may touch are noted, and the note goes once the counts are
written; while a note stands (the job was lost in between) its cities are counted from their own folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.operators import analytics
from leadloom.operators.writes import only_cities_of, with_insert_defaults
from leadloom.sizing import bounded_broadcast, checkpointed, remove_folder, stored
from leadloom.sources import store

KEY = ["city", "status", "final_score"]
COUNTS = "city string, status string, final_score int, n bigint"


def count_rows(rows: DataFrame, sign: int = 1) -> DataFrame:
    """The partial state of some rows; a negative sign withdraws them. A row without a city is in the blank one."""
    city = F.coalesce("city", F.lit("")).alias("city")
    return rows.select(city, "status", F.col("final_score").cast("int").alias("final_score")).groupBy(*KEY).agg((F.count("*") * sign).alias("n"))


def merged(*states: DataFrame) -> DataFrame:
    """States added up; keys without rows go."""
    whole = states[0]
    for s in states[1:]:
        whole = whole.unionByName(s)
    return whole.groupBy(*KEY).agg(F.sum("n").alias("n")).filter("n <> 0")


class CountedStore:
    """A stored table with its counts, for one writer at a time. A change has a name, which its files begin with; a
    change that is run again counts what it changes then, so a replay that changes nothing counts nothing."""

    def __init__(self, spark: SparkSession, path: str, counts_path: str) -> None:
        self.spark, self.path, self.counts_path = spark, path, counts_path

    def append(self, rows: DataFrame, name: str, now: Column | None = None) -> None:
        ready = stored(store.conform(with_insert_defaults(rows, now)))
        self._change(name, ready, lambda: store.append_prospects(ready, self.path, now), lambda: [count_rows(ready)])

    def change_status(self, changes: DataFrame, name: str, order: str = "change_no", now: Column | None = None) -> None:
        self._by_id(changes, name, lambda: store.change_status(self.spark, self.path, changes, order, now))

    def remove_ids(self, ids: DataFrame, name: str) -> None:
        self._by_id(ids, name, lambda: store.remove_ids(self.spark, self.path, ids))

    def upsert(self, incoming: DataFrame, name: str, overwrite: Sequence[str] = ("name", "website_url"), now: Column | None = None) -> None:
        self._by_id(incoming, name, lambda: store.upsert_prospects(self.spark, self.path, incoming, overwrite, now), incoming)

    def drop_cities(self, cities: DataFrame, name: str) -> None:
        """No row is read: what the cities' counts say is withdrawn."""
        named = checkpointed(cities.select(F.coalesce(keys.city_key("city"), F.lit("")).alias("city")).distinct())
        gone = checkpointed(self.counts().join(bounded_broadcast(named), "city", "left_semi").withColumn("n", -F.col("n")))
        self._change(name, named, lambda: store.drop_cities(self.spark, self.path, named), lambda: [gone])

    def _by_id(self, ids: DataFrame, name: str, change: Callable[[], None], arriving: DataFrame | None = None) -> None:
        wanted = checkpointed(ids.select("id").distinct())
        columns = ["id", *KEY]
        before = checkpointed(store.with_ids(store.read_or_empty(self.spark, self.path).select(columns), wanted))
        touched = before.select("city")
        if arriving is not None:
            touched = touched.unionByName(arriving.select(F.coalesce(keys.city_key("city"), F.lit("")).alias("city")))

        def delta() -> list[DataFrame]:
            after = store.with_ids(store.read_or_empty(self.spark, self.path).select(columns), wanted)
            return [count_rows(before, -1), count_rows(after)]

        self._change(name, touched, change, delta)

    def _change(self, name: str, touched: DataFrame, change: Callable[[], None], delta: Callable[[], list[DataFrame]]) -> None:
        name = f"{name}-{uuid.uuid4().hex}"
        base, note = self._generation(), f"{self.counts_path}/open/{name}"
        touched.select(F.coalesce("city", F.lit("")).alias("city")).distinct().write.parquet(note)
        change()
        merged(*delta()).write.parquet(f"{base}/{name}")
        remove_folder(self.spark, note)

    def _generations(self) -> list[int]:
        fs, root = store._file_system(self.spark, self.counts_path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit())

    def _generation(self) -> str:
        """The folder of the latest generation; one whose base was not written whole does not count."""
        for g in reversed(self._generations()):
            if not g or store.table_exists(self.spark, f"{self.counts_path}/g{g}/base/_SUCCESS"):
                return f"{self.counts_path}/g{g}"
        return f"{self.counts_path}/g0"

    def _read_all(self, folder: str, schema: str) -> DataFrame:
        if not store.table_exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)

    def counts(self) -> DataFrame:
        """(city, status, final_score, n) of all stored rows."""
        kept = merged(self._read_all(self._generation(), COUNTS))
        open_cities = checkpointed(self._read_all(f"{self.counts_path}/open", "city string").distinct())
        if open_cities.isEmpty():
            return kept
        now = count_rows(only_cities_of(store.read_or_empty(self.spark, self.path), open_cities))
        return kept.join(bounded_broadcast(open_cities), "city", "left_anti").unionByName(now)

    def compact(self) -> None:
        """One row per key from here on; also settles changes that were left open."""
        whole = checkpointed(self.counts())
        last = (self._generations() or [0])[-1]
        whole.write.mode("overwrite").parquet(f"{self.counts_path}/g{last + 1}/base")
        remove_folder(self.spark, f"{self.counts_path}/open")
        for g in range(last + 1):
            remove_folder(self.spark, f"{self.counts_path}/g{g}")

    def city_stats(self) -> DataFrame:
        return city_stats(self.counts())

    def city_rollup(self) -> DataFrame:
        return city_rollup(self.counts())

    def dashboard(self, top_cities: int = 10) -> DataFrame:
        return dashboard(self.counts(), top_cities)


def _score_sum() -> Column:
    return F.sum(F.col("final_score").cast("bigint") * F.col("n"))


def _scored() -> Column:
    return F.sum(F.when(F.col("final_score").isNotNull(), F.col("n")))


def city_stats(counts: DataFrame) -> DataFrame:
    """As ``analytics.city_stats`` of the rows counted."""
    mean = _score_sum().cast("decimal(20,0)") / _scored().cast("decimal(20,0)")
    return counts.groupBy("city").agg(
        F.sum("n").alias("total_prospects"), F.bround(mean, 2).cast("double").alias("avg_score"), F.max("final_score").alias("top_score")
    )


def city_rollup(counts: DataFrame) -> DataFrame:
    """As ``analytics.city_rollup``."""
    with_status = [
        F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).alias(f"{s}_count") for s in ("new", "contacted", "converted")
    ]
    return counts.groupBy("city").agg(
        F.sum("n").alias("total_prospects"), (_score_sum().cast("double") / _scored()).alias("avg_score"),
        F.max("final_score").alias("top_score"), *with_status,
    ).orderBy(F.desc("total_prospects"), "city")


def dashboard(counts: DataFrame, top_cities: int = 10) -> DataFrame:
    """As ``analytics.dashboard``."""
    band = analytics.score_band(F.col("final_score")).alias("band")
    return analytics.dashboard_of(counts.groupBy("status", "city", band).agg(F.sum("n").alias("n")), top_cities)
