"""Encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import merging, pieces
from leadloom.llm.queries import PIECE_MODEL, tokenizer_file

MODEL = tokenizer_file(PIECE_MODEL)
BITS = [
    " ", "  ", "\n", "a", "b", "the", "ing", "é", "漢", "字", "😀", "▁", "0", "1", "\t", "\x00", "x", ".", " " * 40,
    "!!", "==", "aaaa", "ab", "<s>", "<0x41>", "<unk>", "\r\n", "ﬁ", "​", "�", "الع", "ÀÉ",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return pieces.PieceCodec(MODEL)


def same(codec, library, texts):
    ids, counts = codec.encode(texts)
    decoded, at = codec.decode(ids, counts), 0
    for text, n, back in zip(texts, counts.tolist(), decoded):
        want = library.encode(text)
        assert ids[at:at + n].tolist() == want, repr(text[:80])
        assert back.decode() == library.decode(want), repr(text[:80])
        at += n


def test_random_texts(codec, library):
    rnd = random.Random(3)
    same(codec, library, ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)])


def test_runs_of_spaces_and_letters(codec, library):
    same(codec, library, [" " * n for n in range(100)] + [" " * n + "the" for n in range(70)] + ["a" * n for n in range(0, 90, 3)])


def test_very_long_texts(codec, library):
    same(codec, library, ["a" * 60_000, "ab" * 30_000, "漢字" * 20_000, " " * 50_000 + "x", "word " * 20_000])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(codec, library, text):
    same(codec, library, [text])


def test_a_full_cache_starts_anew(library):
    small = pieces.PieceCodec(MODEL, cached_words=3)
    for text in ("one two three four five", "five four three two one", "six seven one"):
        same(small, library, [text])


def naive(ranks, word):
    """One merge at a time: least rank, then leftmost."""
    word = list(word)
    while True:
        found = [(ranks[pair][0], k) for k, pair in enumerate(zip(word, word[1:])) if pair in ranks]
        if not found:
            return word
        k = min(found)[1]
        word[k:k + 2] = [ranks[tuple(word[k:k + 2])][1]]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_merge_rounds_equal_single_merges(data):
    """Also for tables whose merges may give better pairs than the one just made, and for equal ranks."""
    symbols = st.integers(0, 6)
    pairs = data.draw(st.dictionaries(st.tuples(symbols, symbols), st.tuples(st.integers(0, 5), symbols), min_size=1, max_size=12))
    words = data.draw(st.lists(st.lists(symbols, max_size=12), min_size=1, max_size=6))
    # symbols made must not merge without end: give every pair a symbol of its own, used by later pairs
    ranks = {pair: (rank, 7 + k) for k, (pair, (rank, _)) in enumerate(sorted(pairs.items()))}
    more = data.draw(st.lists(st.tuples(st.sampled_from([m for _, m in ranks.values()]), symbols, st.integers(0, 5)), max_size=5))
    for k, (left, right, rank) in enumerate(more):
        ranks.setdefault((left, right), (rank, 40 + k))
    left, right, rank, merged = (np.array(c) for c in zip(*[(a, b, r, m) for (a, b), (r, m) in ranks.items()]))
    table = merging.PairTable(left, right, rank, merged)
    flat, sizes = merging.merge_words(table, np.array([s for w in words for s in w], np.int32), np.array([len(w) for w in words]))
    edges = np.r_[0, np.cumsum(sizes)]
    assert [flat[a:b].tolist() for a, b in zip(edges, edges[1:])] == [naive(ranks, w) for w in words]


def test_frames(spark, library):
    texts = [(1, None, "k"), (2, "", "k"), (3, "Hello  world\n", "k"), (3, "Hello  world\n", "k"), (None, "x" * 5000, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(df, MODEL), MODEL).collect()
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in out) == sorted(
        (i or 0, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in texts)
    digests = pieces.round_trip_digests(df, MODEL).collect()
    for r in digests:
        text = {1: "", 2: "", 3: "Hello  world\n", None: "x" * 5000}[r.doc_id]
        ids = library.encode(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.round_trip_digests(df.limit(0), MODEL).count() == 0
