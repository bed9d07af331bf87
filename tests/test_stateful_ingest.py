"""Ingest with streaming state: one batch or many, restart, lost commits, late duplicates, no reads of the store."""

import shutil

import pytest
from conftest import values
from pyspark.sql import functions as F

from leadloom.sources import store
from leadloom.streaming import ingest

CANDIDATE = "pos bigint, name string, website_url string, city string, store_count int"


def feed(spark, source, rows):
    spark.createDataFrame(rows, CANDIDATE).coalesce(1).write.mode("append").parquet(source)


def run(spark, tmp_path, checkpoint, order=("pos",), score=lambda df: df, **more):
    schema = spark.createDataFrame([], CANDIDATE).schema
    stream = ingest.candidate_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    query = ingest.start_stateful_ingest(stream, str(tmp_path / "out"), str(tmp_path / checkpoint), score, order, **more)
    query.awaitTermination()
    return query


def stored(spark, tmp_path):
    return sorted(values(store.read_prospects(spark, str(tmp_path / "out")), "city", "domain", "name"), key=str)


def rows_of(part, n=30):
    return [(i, f"B{i}", f"https://b{i % 17}.com/{i}", f" C{i % 3}" if i % 5 else None, i % 5) for i in range(part * n, part * n + n)]


def expected(parts):
    """The first arrival by batch, then by position."""
    first = {}
    for part in parts:
        for pos, name, url, city, _ in sorted(part):
            first.setdefault(((city or "").strip().lower(), url.split("/")[2]), name)
    return sorted(((c, d, n) for (c, d), n in first.items()), key=str)


def test_restarts_replays_and_late_duplicates(spark, tmp_path):
    parts = [rows_of(0), rows_of(1), [*rows_of(0)[::-1], *rows_of(2)], rows_of(1)]
    for part in parts[:2]:
        feed(spark, str(tmp_path / "in"), part)
    run(spark, tmp_path, "cp")
    assert stored(spark, tmp_path) == expected(parts[:2])
    run(spark, tmp_path, "cp")  # nothing new
    for part in parts[2:]:
        feed(spark, str(tmp_path / "in"), part)
    run(spark, tmp_path, "cp")  # duplicates of earlier batches, in other order
    assert stored(spark, tmp_path) == expected(parts)
    run(spark, tmp_path, "cp2")  # a full replay under a new checkpoint
    assert stored(spark, tmp_path) == expected(parts)


def test_known_brands_stay_out(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), rows_of(0))
    known = spark.createDataFrame([("b1.com", "c1"), ("b2.com", "c2"), ("x.com", "c1")], "domain string, city string")
    run(spark, tmp_path, "cp", also_known=known)
    want = [r for r in expected([rows_of(0)]) if (r[1], r[0]) not in {("b1.com", "c1"), ("b2.com", "c2")}]
    assert stored(spark, tmp_path) == want


def test_a_batch_saved_but_not_committed(spark, tmp_path):
    """The job is lost after a batch was saved; the batch is run again and adds nothing."""
    for part in range(3):
        feed(spark, str(tmp_path / "in"), rows_of(part))
    run(spark, tmp_path, "cp")
    whole = stored(spark, tmp_path)
    last = max(int(p.name) for p in (tmp_path / "cp" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "cp" / "commits").iterdir():
        if p.name.strip(".").removesuffix(".crc") == str(last):
            p.unlink()
    run(spark, tmp_path, "cp")
    assert stored(spark, tmp_path) == whole == expected([rows_of(k) for k in range(3)])


def test_a_job_lost_before_saving(spark, tmp_path):
    for part in range(2):
        feed(spark, str(tmp_path / "in"), rows_of(part))
    calls = []

    def lost(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return df

    with pytest.raises(Exception, match="lost"):
        run(spark, tmp_path, "cp", score=lost)
    assert stored(spark, tmp_path) == expected([rows_of(0)])
    run(spark, tmp_path, "cp")
    assert stored(spark, tmp_path) == expected([rows_of(0), rows_of(1)])


def test_later_batches_do_not_read_the_store(spark, tmp_path, monkeypatch):
    reads = []
    plain = ingest.read_or_empty
    monkeypatch.setattr(ingest, "read_or_empty", lambda *a: (reads.append(a), plain(*a))[1])
    for part in range(5):
        feed(spark, str(tmp_path / "in"), rows_of(part))
    query = run(spark, tmp_path, "cp", score=lambda df: df.withColumn("final_score", F.lit(7)))
    assert len(reads) == 2  # the known keys, and the first batch of the run
    state = query.lastProgress["stateOperators"][0]
    assert any("rocksdb" in name.lower() for name in state["customMetrics"])
    assert state["numRowsTotal"] == len(stored(spark, tmp_path)) == len(expected([rows_of(k) for k in range(5)]))
