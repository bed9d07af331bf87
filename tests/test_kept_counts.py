"""Kept statistics against recomputation, after any mix of changes, replays and lost jobs."""

import random

import pytest
from pyspark.sql import functions as F

from leadloom.operators import analytics
from leadloom.schemas import PROSPECTS, STATUSES
from leadloom.sources import kept_counts, store

CHANGE = "id string, status string, change_no int, notes string"


def rows_of(spark, rng, first, n):
    cities = ["hot"] * 4 + ["a b", "c/d", "", None, "e", "f"]
    made = [(f"i{k}", f"d{k}.com", rng.choice(cities), rng.choice(STATUSES), rng.choice([0, 50, 65, 99, rng.randint(0, 100)])) for k in range(first, first + n)]
    df = spark.createDataFrame(made, "id string, domain string, city string, status string, final_score int")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in PROSPECTS.fields if f.name not in df.columns]
    return df.select("*", *missing).select(*[f.name for f in PROSPECTS.fields])


def same(counted, spark):
    rows = store.read_or_empty(spark, counted.path)
    for kept, plain in (
        (counted.city_stats(), analytics.city_stats(rows)), (counted.city_rollup(), analytics.city_rollup(rows)),
        (counted.dashboard(3), analytics.dashboard(rows, 3)),
    ):
        assert kept.columns == plain.columns
        assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))


def test_any_mix_of_changes(spark, tmp_path):
    rng = random.Random(8)
    counted = kept_counts.CountedStore(spark, str(tmp_path / "rows"), str(tmp_path / "counts"))
    same(counted, spark)
    counted.append(rows_of(spark, rng, 0, 300), "batch")
    same(counted, spark)
    counted.append(rows_of(spark, rng, 300, 40), "batch")
    counted.change_status(spark.createDataFrame([(f"i{rng.randrange(400)}", rng.choice(["contacted", "converted", "no such"]), k, None) for k in range(60)], CHANGE), "calls")
    same(counted, spark)
    top = store.read_prospects(spark, counted.path).filter("final_score >= 90").select("id")
    counted.remove_ids(top, "best go")  # maxima fall
    same(counted, spark)
    counted.compact()
    same(counted, spark)
    incoming = rows_of(spark, rng, 330, 30)  # ten new ids
    counted.upsert(incoming, "news")
    counted.upsert(incoming, "news")
    same(counted, spark)
    counted.drop_cities(spark.createDataFrame([(" HOT ",), ("nowhere",), (None,)], "city string"), "closed")
    same(counted, spark)
    counted.compact()
    same(counted, spark)
    assert counted.counts().filter("city = 'hot'").isEmpty()
    assert sorted(p.name for p in (tmp_path / "counts").iterdir() if not p.name.startswith(".")) == ["g2"]


@pytest.mark.parametrize("lost", ["rows", "counts"])
def test_a_job_lost_between_the_writes(spark, tmp_path, lost):
    """The cities that a lost change may have touched are counted anew, before and after the change is run again."""
    rng = random.Random(3)
    counted = kept_counts.CountedStore(spark, str(tmp_path / "rows"), str(tmp_path / "counts"))
    counted.append(rows_of(spark, rng, 0, 120), "first")
    gone = spark.createDataFrame([(f"i{k}",) for k in range(0, 120, 3)], "id string")

    def fails():
        raise RuntimeError

    touched = store.read_prospects(spark, counted.path).join(gone, "id").select("city")
    with pytest.raises(RuntimeError):
        if lost == "rows":  # noted, then lost before the rows were written
            counted._change("gone", touched, fails, lambda: [])
        else:  # rows written, counts not
            counted._change("gone", touched, lambda: store.remove_ids(spark, counted.path, gone), fails)
    same(counted, spark)
    counted.remove_ids(gone, "gone")
    same(counted, spark)
    counted.compact()
    same(counted, spark)
    assert not (tmp_path / "counts" / "open").exists()


def test_compaction_that_was_not_finished(spark, tmp_path):
    counted = kept_counts.CountedStore(spark, str(tmp_path / "rows"), str(tmp_path / "counts"))
    counted.append(rows_of(spark, random.Random(1), 0, 50), "first")
    (tmp_path / "counts" / "g1" / "base").mkdir(parents=True)  # no _SUCCESS
    same(counted, spark)
    counted.append(rows_of(spark, random.Random(2), 50, 50), "second")
    counted.compact()
    same(counted, spark)


def test_a_report_reads_no_stored_row(spark, tmp_path):
    counted = kept_counts.CountedStore(spark, str(tmp_path / "rows"), str(tmp_path / "counts"))
    counted.append(rows_of(spark, random.Random(1), 0, 50), "first")
    assert all("/counts/" in f for f in counted.city_rollup().inputFiles())
