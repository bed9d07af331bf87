"""Every stage against a plain version on its own input; registration and SQL."""

import pytest
from compare import compare, oracle_connection

import __spark_entry__ as entry
import corpus_pipeline
from leadloom.llm import byte_cnn, lang_profiles, queries
from leadloom.llm.common import held_out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def odd(spark, small):
    """The given documents with nulls, empty and repeated rows and clashing extra columns."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    first = docs.orderBy("doc_id").limit(2)
    more = spark.createDataFrame([(-1, None, "en", None, None), (-2, "", None, "s", 0), (None, "the of and then " * 30, "en", "s", 1)], docs.schema)
    return docs.unionByName(first).unionByName(more).selectExpr("*", "'x' as lang_pred", "1 as quality_score", "2 as fp", "3 as text_")


def test_language_stage(spark, small):
    docs = odd(spark, small)
    kept = corpus_pipeline.language_id(spark, docs, small)
    profiles = lang_profiles.learn(lang_profiles.sample(docs))
    table = lang_profiles._code_table(profiles.letters, len(profiles.letters) + 1)

    def good(text):
        far = lang_profiles.distances(text or "", profiles, table)
        return far is not None and 1 - far.min() >= corpus_pipeline.LEAST_LANGUAGE_SCORE

    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted((tuple(r) for r in docs.collect() if good(r.text)), key=str)


def test_quality_stage(spark, small):
    docs = odd(spark, small)
    kept = corpus_pipeline.quality(spark, docs, small)
    net = byte_cnn.train(byte_cnn.sample(docs, spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")))
    tables = net.pair_tables()
    want = [tuple(r) for r in docs.collect() if byte_cnn.probability((r.text or "").encode(), net, tables) >= corpus_pipeline.LEAST_QUALITY]
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(want, key=str)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    n = min(5, len(words))
    return frozenset(b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)) if words else frozenset()


def test_near_duplicate_stage(spark, small):
    docs = odd(spark, small)
    kept = corpus_pipeline.near_duplicates(spark, docs, small)
    sets = {}
    for r in docs.collect():
        sets.setdefault(shingle_set(r.text), []).append(r)
    left, want = set(sets), []
    while left:  # grow classes of sets
        group, todo = set(), [left.pop()]
        while todo:
            s = todo.pop()
            group.add(s)
            near = {x for x in left if 5 * len(s & x) >= 4 * len(s | x)}
            left -= near
            todo += near
        members = [r for s in group for r in sets[s] if r.doc_id is not None]
        if members:
            want.append(tuple(min(members, key=lambda r: r.doc_id)))
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(want, key=str)


def test_whole_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    ids = {r.doc_id for r in out.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, small)
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}
    junk = [i for i, q in labels.items() if q == 0]
    assert len(ids & set(junk)) <= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_duplicates", "best_fit_packing"]


def test_bounds_on_held_out_documents(spark):
    """Where the sample is large: nearly all bad documents go and clean ones stay, in both filtering stages."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(held_out("doc_id"))
    kept = corpus_pipeline.quality(spark, docs, folder).select("doc_id", "lang").join(labels, "doc_id").collect()
    known = labels.collect()
    assert sum(r.quality == 0 for r in kept) <= 0.02 * sum(r.quality == 0 for r in known)
    assert sum(r.quality == 1 for r in kept) >= 0.99 * sum(r.quality == 1 for r in known)
    assert corpus_pipeline.language_id(spark, docs, folder).count() >= 0.999 * docs.filter("lang is not null").count()


def test_empty_corpus(spark, small, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = set(entry.queries())
    assert set(queries.QUERIES) | {"pipeline"} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    ok, message = compare(spark, oracle_connection(small), name, queries.QUERIES[name], queries.ORACLES[name], small)
    assert ok, message
