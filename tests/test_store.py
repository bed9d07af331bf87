import os

from conftest import values
from pyspark.sql import functions as F

from leadloom.operators import outreach, writes
from leadloom.schemas import PROSPECTS
from leadloom.sources import records, store
from leadloom.sources.fixtures import frame
from leadloom.streaming import ingest

CANDIDATE = "pos bigint, name string, website_url string, city string, store_count int"


def candidates(spark, rows):
    return spark.createDataFrame(rows, CANDIDATE)


FIRST = [(1, "A", "https://www.a.com/x", "London", 2), (2, "A2", "http://a.com", " london ", 3),
         (3, "B", "https://b.com", "Paris", None), (4, "A", "https://a.com", "Paris", 9)]


def test_append_defaults_and_read(spark, tmp_path):
    path = str(tmp_path / "p")
    assert store.read_or_empty(spark, path).count() == 0
    ingest.save_batch(candidates(spark, FIRST), path, lambda df: df.withColumn("final_score", F.lit(61.9)))
    df = store.read_prospects(spark, path)
    assert df.schema == PROSPECTS
    got = sorted(values(df, "city", "domain", "store_count", "final_score", "status", "country_code"))
    assert got == [("london", "a.com", 2, 61, "new", "XX"), ("paris", "a.com", 9, 61, "new", "XX"),
                   ("paris", "b.com", 0, 61, "new", "XX")]
    assert sorted(d for d in os.listdir(path) if d.startswith("city=")) == ["city=london", "city=paris"]


def test_batch_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "p")
    for _ in range(2):
        ingest.save_batch(candidates(spark, FIRST), path, lambda df: df)
    assert store.read_prospects(spark, path).count() == 3
    ingest.save_batch(candidates(spark, [*FIRST, (9, "C", "https://c.com", "Rome", 1)]), path, lambda df: df)
    assert store.read_prospects(spark, path).count() == 4


def test_batch_report(spark):
    existing = spark.createDataFrame([("a.com", "london")], "domain string, city string")
    got = sorted(values(writes.batch_report(candidates(spark, FIRST), existing), "city", "candidates", "new_saved", "duplicates_skipped"))
    assert got == [("london", 2, 0, 2), ("paris", 2, 2, 0)]


def test_replace_only_touched_cities(spark, tmp_path):
    path = str(tmp_path / "p")
    ingest.save_batch(candidates(spark, FIRST), path, lambda df: df)
    untouched = {f: os.path.getmtime(tmp_path / "p" / "city=london" / f) for f in os.listdir(tmp_path / "p" / "city=london")}
    paris = store.read_prospects(spark, path).filter("city = 'paris'")
    changes = paris.filter("domain = 'b.com'").select("id", F.lit(1).alias("change_no"), F.lit("contacted").alias("status"), F.lit("called").alias("notes"))
    store.replace_cities(writes.update_status(paris, changes, now=F.current_timestamp()), path)
    df = store.read_prospects(spark, path)
    assert sorted(values(df, "city", "domain", "status", "notes")) == [
        ("london", "a.com", "new", None), ("paris", "a.com", "new", None), ("paris", "b.com", "contacted", "called")]
    assert untouched == {f: os.path.getmtime(tmp_path / "p" / "city=london" / f) for f in os.listdir(tmp_path / "p" / "city=london")}


def test_remove_ids_and_cities(spark, tmp_path):
    path = str(tmp_path / "p")
    ingest.save_batch(candidates(spark, [*FIRST, (5, "D", "https://d.com", "São/Paulo x", 1)]), path, lambda df: df)
    df = store.read_prospects(spark, path)
    store.remove_ids(spark, path, df.filter("domain in ('b.com', 'd.com')").select("id"))
    left = sorted(values(store.read_prospects(spark, path), "city", "domain"))
    assert left == [("london", "a.com"), ("paris", "a.com")]
    store.remove_ids(spark, path, spark.createDataFrame([("no such id",)], "id string"))
    store.drop_cities(spark, path, spark.createDataFrame([("  London ",), ("atlantis",)], "city string"))
    assert values(store.read_prospects(spark, path), "city", "domain") == [("paris", "a.com")]


def test_city_filter_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    ingest.save_batch(candidates(spark, FIRST), path, lambda df: df)
    known = writes.only_cities_of(store.read_prospects(spark, path), spark.createDataFrame([("paris",), ("oslo",)], "city string"))
    assert "dynamicpruning" in known.select("domain")._jdf.queryExecution().executedPlan().toString()
    assert known.count() == 2


def test_blank_cities_are_stored_and_found_again(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = [(1, "A", "https://a.com", "", 1), (2, "A2", "https://a.com/2", None, 1), (3, "B", "https://b.com", "  ", 1), (4, "C", "https://c.com", "Rome", 1)]
    for _ in range(2):  # the second run finds nothing new
        ingest.save_batch(candidates(spark, rows), path, lambda df: df)
        assert sorted(values(store.read_prospects(spark, path), "city", "domain")) == [("", "a.com"), ("", "b.com"), ("rome", "c.com")]
    store.remove_ids(spark, path, store.read_prospects(spark, path).filter("domain = 'a.com'").select("id"))
    assert sorted(values(store.read_prospects(spark, path), "city", "domain")) == [("", "b.com"), ("rome", "c.com")]
    store.drop_cities(spark, path, spark.createDataFrame([(None,)], "city string"))
    assert values(store.read_prospects(spark, path), "city", "domain") == [("rome", "c.com")]


def test_legacy_scores_keep_their_integer_part(spark):
    rows = spark.createDataFrame([("72.5", 12.7), (" 8 ", None), ("x", 3.0)], "final_score string, store_count double")
    assert values(records.import_legacy(rows), "final_score", "store_count") == [(72, 12), (8, 0), (0, 3)]


def test_stream_equals_one_batch_and_replay_adds_nothing(spark, tmp_path):
    source, one, many = str(tmp_path / "in"), str(tmp_path / "one"), str(tmp_path / "many")
    rows = [(i, f"B{i % 17}", f"https://b{i % 17}.com/{i}", f"c{i % 3}", i % 5) for i in range(120)]
    for part in range(4):
        candidates(spark, rows[part * 30 : part * 30 + 30]).coalesce(1).write.mode("append").parquet(source)
    ingest.save_batch(candidates(spark, rows), one, lambda df: df)

    def run(checkpoint):
        stream = ingest.candidate_stream(spark, source, candidates(spark, []).schema, files_per_batch=1)
        ingest.start_ingest(stream, many, str(tmp_path / checkpoint), lambda df: df).awaitTermination()
        return sorted(values(store.read_prospects(spark, many), "city", "domain"))

    want = sorted(values(store.read_prospects(spark, one), "city", "domain"))
    assert len(want) == 51
    assert run("cp1") == want
    assert run("cp1") == want  # nothing new
    assert run("cp2") == want  # a full replay


def test_suppression_is_idempotent(spark, small):
    table, requests = frame(spark, small, "suppression"), frame(spark, small, "opt_outs")
    once = writes.suppress(table, requests)
    assert sorted(values(writes.suppress(once, requests), "domain", "reason")) == sorted(values(once, "domain", "reason"))


def test_legacy_csv(spark, tmp_path):
    f = tmp_path / "old.csv"
    f.write_text('id,store_count,material_composition,status\n1, 4 ,"[""wool"",""silk""]",\n2,many,broken,contacted\n', encoding="utf-8")
    rows = records.read_legacy_csv(spark, str(f), ["id", "store_count", "material_composition", "status"])
    got = values(records.import_legacy(rows), "id", "store_count", "material_composition", "status")
    assert got == [("1", 4, ["wool", "silk"], "new"), ("2", 0, [], "contacted")]


def test_outreach_texts_and_log(spark):
    brands = spark.createDataFrame(
        [("1", "Acme", "https://www.acme.com/x", "rome", 812.5), ("2", "Bolt", "http://bolt.com", "rome", None),
         ("3", "Acme 2", "http://acme.com", "rome", 1.0), ("4", "Gone", "https://gone.com", "rome", 1.0)],
        "id string, name string, website_url string, city string, avg_suit_price_eur double")
    listed = spark.createDataFrame([("gone.com", "x")], "domain string, reason string")
    log = spark.createDataFrame([("Bolt", "http://bolt.com", "failed", None, None)],
                                "brand_name string, website_url string, status string, error_message string, sent_at timestamp")
    batch = outreach.outreach_batch(brands, listed, log)
    assert sorted(values(batch, "id", "contact", "price_text")) == [("1", "info@acme.com", "€812"), ("2", "info@bolt.com", "$0")]
    assert batch.filter("id = '1'").first()["body"] == "Novo cliente detetado: Acme\nWebsite: https://www.acme.com/x\nCidade: rome"
    after = outreach.append_log(log, outreach.log_rows(batch))
    assert outreach.outreach_batch(brands, listed, after).count() == 0


def scanned_rows(df):
    """Rows that the scan of a plan without a shuffle gave to it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().get("numOutputRows").get().value()


def many_cities(spark, path, cities=12, rows=2_000):
    df = spark.range(cities * rows).selectExpr(
        "concat('id-', id) as id", "concat('d', id, '.com') as domain", f"concat('city ', id % {cities}) as city", "cast(id % 7 as int) as store_count")
    store.append_prospects(store.conform(df.selectExpr(
        "*", *[f"cast(null as {f.dataType.simpleString()}) as {f.name}" for f in PROSPECTS.fields if f.name not in df.columns])), path)


def test_a_few_ids_read_few_rows(spark, tmp_path):
    """One id reads the row group that holds it; the others' Bloom filters rule them out."""
    path = str(tmp_path / "t")
    many_cities(spark, path)
    table = store.read_prospects(spark, path)
    for wanted in (["id-17"], ["id-17", "id-29", "id-5"], [f"id-{12 * k + 3}" for k in range(30)], ["id-1000000"]):
        ids = spark.createDataFrame([(i,) for i in wanted] + [(None,)], "id string")
        found = store.with_ids(table.select("id", "city"), ids)
        assert sorted(r.id for r in found.collect()) == sorted(i for i in wanted if i != "id-1000000")
        cities = {int(i[3:]) % 12 for i in wanted if i != "id-1000000"}
        assert scanned_rows(found) <= 2_000 * (len(cities) + 1)  # one false positive in a hundred
    many = spark.range(0, 24_000, 40).selectExpr("concat('id-', id) as id")
    assert store.with_ids(table, many).count() == 600


def test_changes_through_the_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    many_cities(spark, path, cities=6, rows=300)
    before = {c.name: max(f.stat().st_mtime_ns for f in c.iterdir()) for c in (tmp_path / "t").iterdir() if c.name.startswith("city=")}
    store.change_status(spark, path, spark.createDataFrame([("id-8", "contacted", 1, None), ("id-x", "contacted", 2, "")], "id string, status string, change_no int, notes string"))
    after = {c.name: max(f.stat().st_mtime_ns for f in c.iterdir()) for c in (tmp_path / "t").iterdir() if c.name.startswith("city=")}
    assert {c for c in before if before[c] != after[c]} == {"city=city%202"} or {c for c in before if before[c] != after[c]} == {"city=city 2"}
    store.remove_ids(spark, path, spark.range(0, 1_800, 6).selectExpr("concat('id-', id) as id"))  # a whole city, and more than a few ids
    table = store.read_prospects(spark, path)
    assert table.count() == 1_500 and table.filter("city = 'city 0'").count() == 0
    assert [r.status for r in table.filter("id = 'id-8'").collect()] == ["contacted"]
    store.drop_cities(spark, path, spark.createDataFrame([(" CITY 1",), ("city 3",), ("nowhere",), (None,)], "city string"))
    assert store.read_prospects(spark, path).select("city").distinct().count() == 3


def test_upsert_computes_what_comes_in_once(spark, tmp_path):
    path = str(tmp_path / "prospects")
    ids = [(f"i{k:03}", f"n{k}", f"https://s{k}.example/", f"s{k}.example", f"c{k % 3}") for k in range(300)]
    schema = "id string, name string, website_url string, domain string, city string"
    store.append_prospects(spark.createDataFrame(ids[:200], schema), path)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    incoming = spark.createDataFrame([(i, n + "!", u, d, "c9") for i, n, u, d, _ in ids[100:]], schema).mapInArrow(counted, schema)
    store.upsert_prospects(spark, path, incoming)
    assert seen.value == 200
    got = {r.id: (r.name, r.city) for r in store.read_prospects(spark, path).collect()}
    assert got == {i: (n + "!" if k >= 100 else n, c if k < 200 else "c9") for k, (i, n, _, _, c) in enumerate(ids)}
