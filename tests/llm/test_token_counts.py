"""Token counts against the tokenizer library, and the transducers against plain versions."""

import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from leadloom.llm import queries, token_counts, word_cuts
from leadloom.llm.count_machine import CountMachine, Merges

MODEL = queries.tokenizer_file(queries.BYTE_MODEL)
LIBRARY = Tokenizer.from_file(MODEL)
COUNTER = token_counts.TokenCounter(token_counts.compiled(MODEL))
PIECES = [
    "'", "s", "r", "e", "l", "v", "d", " ", "  ", "\n", "\t", "a", "B", "1", "é", "²", "!", "　", "😀", "日", "<|endoftext|>", "<|", "endoftext|>",
    "\x1c", "​", "\x85", "the", " in", "tion",
]
ODD = [
    None, "", "a", "don't we'll I've 's 'S ''s", "a  b\n\n c  \n", "  ", "\n", "x\t\ty", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    "a" * 5_000, " " * 5_000, "\n " * 3_000, "日本語テキスト。" * 200, "ab" * 40_000 + " x", "'" * 300 + "s", "word " * 60_000,
]


def library_counts(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_odd_texts():
    texts = [t or "" for t in ODD]
    assert COUNTER.counts(texts).tolist() == library_counts(texts)
    assert COUNTER.counts([]).tolist() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=5))
def test_joined_pieces(texts):
    assert COUNTER.counts(texts).tolist() == library_counts(texts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert COUNTER.counts([text]).tolist() == library_counts([text])


def test_every_character_has_the_class_of_the_library():
    """Also above what is probed: one of each plane's kinds, and all assigned ones."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    chars = [chr(c) for c in points if c < 0x3400 or c % 7 == 0]
    texts = [f"a{c}a 1{c}1{c} !{c}!{c}{c} x" for c in chars]
    wrong = [t for t, a, b in zip(texts, COUNTER.counts(texts).tolist(), library_counts(texts)) if a != b]
    assert not wrong


def test_states_started_anew():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdeshion' ", k=rng.randint(0, 400))) for _ in range(300)]
    few = token_counts.TokenCounter(token_counts.compiled(MODEL))
    few.machine = CountMachine(few.machine.merges, most_states=50)
    texts.append("abcdefgh" * 500)
    assert few.counts(texts).tolist() == library_counts(texts)


def plain_merge(pairs, word):
    parts = [bytes([b]) for b in word]
    rank = {p: k for k, p in reversed(list(enumerate(pairs)))}
    while True:
        found = [(rank[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in rank]
        if not found:
            return parts
        _, k = min(found)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32))
def test_small_vocabularies(seed):
    rng = random.Random(seed)
    tokens, pairs = [b"a", b"b", b"c"], []
    for _ in range(rng.randint(0, 14)):
        pair = rng.choice(tokens), rng.choice(tokens)
        if pair[0] + pair[1] not in tokens:
            pairs.append(pair)
            tokens.append(pair[0] + pair[1])
    merges = Merges(pairs)
    assert set(merges.token) - {bytes([b]) for b in range(256)} == {a + b for a, b in pairs if plain_merge(pairs, a + b) == [a + b]}
    for a in set(tokens) & set(merges.token):
        for b in set(tokens) & set(merges.token):
            assert merges.apart(merges.token[a], merges.token[b]) == (plain_merge(pairs, a + b) == [a, b])
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 90))) for _ in range(40)]
    ends = np.cumsum([0, *map(len, words)])
    got = CountMachine(merges).counts(np.frombuffer(b"".join(words), np.uint8), ends[:-1], np.diff(ends))
    assert got.tolist() == [len(plain_merge(pairs, w)) for w in words]


PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["'", "s", "r", "e", "l", "x", " ", "\n", "1", "!"]), max_size=400).map("".join), max_size=4))
def test_words_over_many_chunks(texts):
    points = np.concatenate([np.array([*map(ord, t), word_cuts.END_POINT], np.int64) for t in texts] or [np.empty(0, np.int64)])
    want, at = [], 0
    for t in texts:
        want += [at + m.start() for m in PATTERN.finditer(t)] + [at + len(t)]
        at += len(t) + 1
    assert np.flatnonzero(word_cuts.word_starts(COUNTER.kinds[points])).tolist() == want


def test_scan_composes():
    maps = np.random.default_rng(1).integers(0, 11, (37, 11))
    want, so_far = [], np.arange(11)
    for m in maps:
        so_far = m[so_far]
        want.append(so_far)
    assert (word_cuts.scanned(maps) == np.array(want)).all()


def test_operator(spark):
    rows = [(k if k % 5 else None, t, "x") for k, t in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens string")
    got = token_counts.count_tokens(df, MODEL).collect()
    want = [(r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, library_counts([r[1] for r in rows]))]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert token_counts.count_tokens(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(df, MODEL, keep=df.columns)
    named = token_counts.count_tokens(df, MODEL, keep=df.columns, names=("size", "count"))
    assert named.columns == [*df.columns, "size", "count"] and named.count() == len(rows)


def test_query_equals_library(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op12_token_counts(spark, small).collect()
    counts = dict(zip(docs, library_counts(docs.values())))
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), counts[r.doc_id], counts[r.doc_id] > 512)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.compiled(queries.tokenizer_file(queries.WORD_MODEL))
