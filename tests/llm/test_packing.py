"""Word tokens against the library; plans and packed tables against their definition."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import packing, word_tokens
from leadloom.llm.queries import WORD_MODEL, tokenizer_file

MODEL = tokenizer_file(WORD_MODEL)
BITS = [
    " ", "  ", "\n", "a", "B", "the", "ING", "é", "漢", "😀", "0", "12", "\t", "\x00", "x", ".", "!!", "==", "'s", "'LL",
    "Σ", "İ", "\x1c", "\x85", "　", "é", "<|endoftext|>", "ſ", "½", "ß",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(MODEL)


def test_word_tokens(library):
    codec, rnd = word_tokens.WordCodec(MODEL, cached_chunks=500), random.Random(5)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["a" * 999, ""]
    for at in range(0, len(texts), 100):
        flat, counts = codec.encode(texts[at:at + 100])
        edges = np.r_[0, np.cumsum(counts)]
        for text, a, b in zip(texts[at:at + 100], edges, edges[1:]):
            assert flat[a:b].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def check_plan(lengths, capacity=4096):
    plan = packing.pattern_plan(dict(Counter(lengths)), capacity)
    starts, rank, first, per, offset = plan.arrays()
    seen, spans = Counter(), defaultdict(list)
    for n in sorted(lengths):
        r = seen[n]
        seen[n] += 1
        k = int(np.searchsorted(starts, (n << 40) + r, side="right")) - 1
        nth = r - rank[k]
        spans[first[k] + nth // per[k]].append((offset[k] + nth % per[k] * n, n))
    for pieces in spans.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= capacity
    assert len(spans) == plan.sequences
    return plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_plans_hold_every_piece_once(lengths):
    plan = check_plan(lengths, 64)
    assert plan.sequences >= -(-sum(lengths) // 64)


def test_plans_are_tight():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6.4, 1.0, 30_000), 1, 4096).astype(int).tolist()
    plan = check_plan(lengths)
    assert plan.sequences <= 1.002 * -(-sum(lengths) // 4096)
    assert len(plan.rows) < 20_000  # bounded by lengths, not by pieces
    assert len(packing.pattern_plan({n: 1000 * c for n, c in Counter(lengths).items()}).rows) < 20_000


def test_patterns_are_used():
    """Two lengths that only fill a sequence together."""
    plan = check_plan([3000] * 500 + [1096] * 500)
    assert plan.sequences == 500
    found = packing.patterns({24: 3000, 9: 1096, 20: 2500}, 4096, 3, 128, (512, 2048))
    assert (24, 9) in found and (9, 9, 9) in found and (24,) in found and (24, 20) not in found


def test_non_negative_least_squares():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.random((6, 9)), rng.random(6)
        x = packing.non_negative_least_squares(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and abs(slope @ x) < 1e-6


def test_packed_table(spark, small, library):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "word " * 9000), (-3, "word " * 9000), (None, "a b")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, length string")
    out = packing.pack(df, MODEL).collect()
    want = Counter()
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            cut = ids[s:s + 4096]
            want[i, p, s, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id].append((r.offset, r.length))
    for pieces in spans.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096
    total = sum(r.length for r in out)
    assert len(spans) <= -(-total // 4096) + max(2, total // 4096 // 50)


def test_no_documents(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), MODEL).count() == 0
