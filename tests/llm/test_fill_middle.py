"""Fill-in-the-middle and its boundary sets against plain versions."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import boundary_set, fill_middle
from leadloom.llm.boundary_set import ArrayContainer, BitmapContainer, BoundarySet, RunContainer

TEXTS = [
    None, "", "a", "ab cd", "é1 <P> x", "x<S>", "<M>", "<<P", "<", "<S", "ends with <", "a<b>c <P x> y<S z", "日本語 text\n\n x", "😀 a\u0000b",
    "word " * 50_000, "x" * 200_000, "- " * 70_000, "1" * 66_000 + "a" * 70_000 + " end", "<P" * 900,
]


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"(?s)[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("kind, values", [
    (ArrayContainer, np.arange(0, 60_000, 100)), (BitmapContainer, np.arange(0, 65_536, 2)), (RunContainer, np.arange(5, 65_000)),
])
def test_containers(kind, values):
    held = boundary_set.container(values)
    assert isinstance(held, kind)
    assert [held.select(k) for k in range(0, len(values), 97)] == values[::97].tolist()
    for low in range(0, 65_536, 331):
        assert held.rank(low) == int((values <= low).sum())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400_000), st.integers(1, 9_000), st.integers(1, 3)), max_size=6))
def test_set_selects_and_ranks(pieces):
    offsets = np.unique(np.concatenate([np.empty(0, np.int64), *(np.arange(a, a + n * s, s) for a, n, s in pieces)])).astype(np.int64)
    held = BoundarySet(offsets)
    assert len(held) == len(offsets)
    for k in {0, len(offsets) // 3, len(offsets) // 2, len(offsets) - 1} & set(range(len(offsets))):
        assert held.select(k) == offsets[k]
        assert held.rank(int(offsets[k])) == k + 1
    for at in (0, 65_535, 65_536, 131_072, 500_000):
        assert held.rank(at) == int((offsets <= at).sum())
    with pytest.raises(IndexError):
        held.select(len(offsets))


@settings(max_examples=200, deadline=None)
@given(st.text("ab <>PSM1é\n", max_size=40), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_restores(text, draws):
    n, form, first, second, output = fill_middle.transform(text, draws)
    assert fill_middle.restore(output, form) == text
    assert n == len(re.findall(r"[A-Za-z]+|[^A-Za-z]", text))


def test_operator(spark):
    rows = [(None if k % 9 == 8 else k % 50, t, k) for k, t in enumerate(TEXTS * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    made = fill_middle.fill_in_middle(df, keep=["doc_id", "text", "extra"])
    got = made.withColumn("back", fill_middle.restored(made)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "") == fill_middle.restore(r.output, r.form)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, Form string, _draws long")
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(df, keep=df.columns)
    out = fill_middle.fill_in_middle(df, keep=df.columns, names={"form": "layout"})
    assert out.columns == [*df.columns, "n", "layout", "prefix_chars", "middle_chars", "output"]
    assert out.first()["Form"] == "x"
