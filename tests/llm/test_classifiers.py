"""Quality network and language profiles: held-out accuracy, whole texts, edges."""

import numpy as np
import pytest

from leadloom.llm import byte_cnn, lang_profiles
from leadloom.llm.common import held_out
from leadloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def network(spark):
    return byte_cnn.train(byte_cnn.sample(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")))


@pytest.fixture(scope="module")
def profiles(spark):
    return lang_profiles.learn(lang_profiles.sample(spark.read.parquet(f"{DATA}/documents.parquet")))


def test_chunks_cover_every_window():
    rng = np.random.default_rng(0)
    for n in (1, 5, 127, 128, 129, 251, 252, 1000, 4097):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        rows = {r.tobytes() for r in byte_cnn.chunk_rows(data)}
        for k in range(max(1, n - byte_cnn.WIDTH + 1)):
            assert any(data[k:k + byte_cnn.WIDTH] in r for r in rows), (n, k)


def test_pair_tables_give_the_plain_convolution():
    rng = np.random.default_rng(0)
    net = byte_cnn.train([(1, b"x")])._replace(filters=rng.normal(size=(byte_cnn.WIDTH, 256, byte_cnn.FILTERS)).astype(np.float32))
    rows = byte_cnn.chunk_rows(rng.integers(0, 256, 700).astype(np.uint8).tobytes())
    assert np.allclose(byte_cnn.responses(rows, net.pair_tables()), byte_cnn._plain_responses(rows, net.filters), atol=1e-5)


def test_held_out_quality(spark):
    out = QUERIES["op2_quality"](spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in rows)
    assert out.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_quality_looks_at_the_whole_text(network):
    tables = network.pair_tables()
    clean, junk = b"the of then and in an onst erly. " * 4000, b"the### of%%% and$$$ in*** then&&& " * 4000
    assert byte_cnn.probability(clean, network, tables) > byte_cnn.probability(clean + junk, network, tables)
    assert byte_cnn.probability(clean, network, tables) > byte_cnn.probability(junk + clean, network, tables)


def test_quality_edges(spark, network):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a", 5), (None, "a", 5), (3, "a", 5), (4, "é" * 200_000, 5)], "doc_id long, text string, score int")
    got = byte_cnn.score(df, network).collect()
    scores = {r.doc_id: r.score for r in got}
    assert len(got) == 6 and scores[1] == scores[2] == 0.0 and scores[3] == scores[None] and 0 <= scores[4] <= 1
    assert byte_cnn.score(df.limit(0), network).count() == 0
    with pytest.raises(ValueError):
        byte_cnn.score(df, network, keep=df.columns)
    kept = byte_cnn.score(df, network, keep=df.columns, name="q")
    assert kept.columns == ["doc_id", "text", "score", "q"]


@pytest.mark.parametrize("rows", [[], [(1, b"good")], [(0, b"bad"), (0, b"worse")]])
def test_one_sided_training(rows):
    net = byte_cnn.train(rows)
    p = byte_cnn.probability(b"text", net, net.pair_tables())
    assert abs(p - (np.mean([y for y, _ in rows]) if rows else 0.5)) < 1e-3


def test_samples_leave_out_held_out_rows(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('t', id) as text", "'en' as lang")
    labels = spark.range(4000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    banned = {f"t{r.doc_id}" for r in docs.filter(held_out("doc_id")).collect()}
    assert len(banned) > 500
    quality = byte_cnn.sample(docs, labels)
    assert 0 < len(quality) <= 2 * byte_cnn.SAMPLE_DOCUMENTS and not banned & {t.decode() for _, t in quality}
    language = lang_profiles.sample(docs).collect()
    assert len(language) == lang_profiles.SAMPLE_DOCUMENTS and not banned & {t for _, t in language}


def test_profiles_learned_where_the_rows_are(spark):
    """Equal to those of the texts at hand, with whole long texts, and for more languages than a bound would keep."""
    rows = [(f"l{k % 1100}", f"word{chr(97 + k % 13) * 3} aà {chr(97 + k % 7)}b") for k in range(2_200)]
    rows += [("l1", "late " * 20_000 + "žžž qqq " * 9_000), ("l2", ""), ("l3", "漢字"), ("zz", "...")]
    got = lang_profiles.learn(spark.createDataFrame(rows, "label string, text string").repartition(5))
    want = lang_profiles.train(rows)
    assert got.languages == want.languages and got.letters == want.letters and (got.places == want.places).all()
    assert lang_profiles.learn(spark.createDataFrame([], "label string, text string")).languages == []


def test_held_out_language(spark):
    out = QUERIES["op6_language"](spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = out.join(docs, "doc_id").filter("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def plain_grams(text, letters, size):
    """N-gram counts by their definition, from a padded string of codes."""
    codes = [0]
    for c in text.lower():
        code = letters.get(ord(c), size if c.isalpha() else 0)
        if code or codes[-1]:
            codes.append(code)
    if codes[-1]:
        codes.append(0)
    out = {}
    for n in (1, 2, 3):
        for k in range(len(codes) - n + 1):
            g = codes[k:k + n]
            if any(g) and all(g[1:-1]) and not (n == 1 and not g[0]):
                key = 0
                for x in g:
                    key = key * (size + 1) + x
                key += sum((size + 1) ** m for m in range(1, n))
                out[key] = out.get(key, 0) + 1
    return out


def test_gram_counts(profiles, monkeypatch):
    size = len(profiles.letters) + 1
    table = lang_profiles._code_table(profiles.letters, size)
    for text in ("", "a", "The  cat's über-ñandú 12 x", "漢字 ab", "z" * 500 + " q"):
        for part in (1 << 20, 7):
            monkeypatch.setattr(lang_profiles, "PART_CHARS", part)
            counts = lang_profiles.count_grams(lang_profiles.letter_codes(text, table), size)
            assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == plain_grams(text, profiles.letters, size), text[:9]


def test_out_of_place_distance():
    rows = [("aa", "abab abab"), ("bb", "cdcd cdcd")]
    got = lang_profiles.train(rows)
    table = lang_profiles._code_table(got.letters, len(got.letters) + 1)
    own = lang_profiles.distances("abab abab", got, table)
    assert own[0] == 0 and own[1] == 1


def test_language_edges(spark, profiles):
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "der die und nicht einer"), (None, "漢字"), (4, "der die und nicht einer"), (5, "the of " * 300_000)]
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = lang_profiles.identify(df, profiles).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 7 and by[1] == by[2] == by[3] == ("und", 0.0) and by[None][0] != "und" and by[5][0] == "en"
    assert lang_profiles.identify(df.limit(0), profiles).count() == 0
    none = lang_profiles.train([])
    assert {r.lang_pred for r in lang_profiles.identify(df, none).collect()} == {"und"}
