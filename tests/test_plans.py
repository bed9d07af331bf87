"""The physical plans that matter at scale."""

from pyspark.sql import functions as F

from leadloom.operators import analytics, discovery, geo, scoring, search, similarity
from leadloom.operators.search import ProspectFilter
from leadloom.sizing import bounded_broadcast, is_small
from leadloom.sources.fixtures import frame


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def before(text, first, second):
    """In the printed tree the parent comes first."""
    return text.index(first) < text.index(second)


def test_choice_per_domain_is_limited_before_the_shuffle(spark, small, tmp_path):
    path = str(tmp_path / "p")
    frame(spark, small, "prospects").write.parquet(path)
    stored = spark.read.parquet(path)
    p = plan(search.search(stored, ProspectFilter(city="nation_1", min_stores=2)).select("id"))
    assert "TakeOrderedAndProject" in p
    assert p.count("WindowGroupLimit") == 2 and "Partial" in p
    assert "PushedFilters: [IsNotNull(city), IsNotNull(store_count), EqualTo(city,nation_1), GreaterThanOrEqual(store_count,2)]" in p
    assert "ReadSchema: struct<id:string,domain:string,city:string,store_count:int,final_score:int>" in p


def test_first_wins_passes_send_one_row_per_key(spark, small):
    p = plan(discovery.dedupe_domains(frame(spark, small, "search_results"), frame(spark, small, "suppression")))
    assert p.count("WindowGroupLimit") == 4
    assert "BroadcastHashJoin" in p and "LeftAnti" in p


def test_page_texts_are_not_shuffled_for_streets(spark, small):
    found = geo.detect_street(frame(spark, small, "contents"), frame(spark, small, "streets"), ["page_id"])
    p = plan(found)
    assert "BroadcastHashJoin" in p and "CartesianProduct" not in p and "NestedLoop" not in p
    probe = p[: p.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in probe


def test_exact_similarity_has_no_join_and_no_shuffle(spark, small):
    ranked = similarity.top_similar(frame(spark, small, "brand_vectors"), frame(spark, small, "client_vectors"), 3)
    p = plan(ranked)
    assert "MapInArrow" in p and "Join" not in p and "Exchange" not in p


def test_larger_similarity_avoids_cross_joins(spark, small):
    ranked = similarity.top_similar(
        frame(spark, small, "brand_vectors"), frame(spark, small, "client_vectors"), 3, matrix_max_bytes=1)
    p = plan(ranked)
    assert "CartesianProduct" not in p and "NestedLoop" not in p and "FlatMapCoGroupsInPandas" in p


def test_distinct_counts_do_not_expand_rows(spark, small):
    assert "Expand" not in plan(search.size_totals(frame(spark, small, "prospects")))
    assert "Expand" not in plan(analytics.facets(frame(spark, small, "prospects")))


def test_scoring_is_a_projection(spark, small):
    rows = frame(spark, small, "prospects").withColumn("similarity", F.lit(50.0)).withColumn("market_share", F.lit(1.0))
    before_score, after = plan(rows), plan(scoring.score(rows))
    assert after.count("Exchange") == before_score.count("Exchange")


def test_broadcast_needs_a_measured_bound(spark):
    rows = 10**6  # estimated too large to be taken at its word
    table = spark.range(rows).withColumn("s", F.lit("x")).withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    assert is_small(table, rows) and not is_small(table, rows - 1) and not is_small(table, rows, 25 * rows - 1)
    assert is_small(spark.range(100))
    hinted = bounded_broadcast(table, rows)._jdf.queryExecution().logical().toString()
    plain = bounded_broadcast(table, 10)._jdf.queryExecution().logical().toString()
    assert "Hint" in hinted and "Hint" not in plain
