"""Streets by automaton: against the list tried one by one, with long lists, skew and odd rows."""

import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.functions.automaton import WordFinder
from leadloom.operators import geo
from leadloom.sources.fixtures import frame

STREETS = "city string, pos int, street string, tier int"
PAGES = "page_id long, city string, content string"


def plain(pages, streets):
    lists = {}
    for city, pos, street, tier in streets:
        if street is not None:
            lists.setdefault((city or "").lower().strip(), []).append((pos, street, tier))
    out = []
    for page, city, text in pages:
        listed = sorted(lists.get((city or "").lower().strip(), [])) if city is not None else []
        hit = next(((s, t) for _, s, t in listed if s in (text or "").lower()), (None, None))
        out.append((page, *hit))
    return sorted(out, key=str)


def found(spark, pages, streets):
    df = geo.detect_street_long_lists(spark.createDataFrame(pages, PAGES), spark.createDataFrame(streets, STREETS))
    assert df.columns == ["page_id", "city", "content", "street", "tier"]
    return sorted((tuple(r) for r in df.select("page_id", "street", "tier").collect()), key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé", max_size=4), max_size=12), st.text("abé ", max_size=30))
def test_finder(words, text):
    finder, present = WordFinder(words), [k for k, w in enumerate(words) if w in text]
    assert finder.first(text) == (present[0] if present else None)
    assert {words[k] for k in finder.all(text)} == {words[k] for k in present}
    assert finder.any(text) == bool(present)


def test_odd_rows(spark):
    streets = [
        ("X ", 1, "long road", 1), ("x", 1, "long road", 3), ("x", 1, "a road", 2), ("x", 0, None, 3), ("y", 4, "", 2), ("y", 3, "rue é", 1),
        ("z", 1, "road", 1), ("z", 2, "long road", 2),
    ]
    pages = [
        (1, "x", "The LONG road"), (1, "x", "a road, a long road"), (2, "y", "RUE É"), (3, "y", None), (4, None, "long road"), (5, "w", "road"),
        (6, "z", "long road"), (7, "x", ""), (8, "X", "x" * 300_000 + " long road"), (None, "x", "a road"),
    ]
    assert found(spark, pages, streets) == plain(pages, streets)
    assert found(spark, pages, []) == plain(pages, [])
    assert found(spark, [], streets) == []


def test_equal_to_the_list_tried_one_by_one(spark, small):
    contents, streets = frame(spark, small, "contents"), frame(spark, small, "streets")
    one = geo.detect_street(contents, streets).select("page_id", "street", "tier")
    other = geo.detect_street_long_lists(contents, streets).select("page_id", "street", "tier")
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_long_lists_cost_about_as_much_as_short_ones(spark):
    """10,000 streets a city in place of 10, and a city that holds a third of the pages."""
    rng = random.Random(1)
    names = [f"{rng.choice('abcdefgh')}{k} street" for k in range(10_000)]
    pages = [(k, "hot" if k % 3 == 0 else f"c{k % 7}", " ".join(rng.choices(names, k=2)) + " words of a page" * 400) for k in range(6_000)]
    cities = ["hot", *(f"c{k}" for k in range(7))]
    taken = {}
    df = spark.createDataFrame(pages, PAGES).repartition(8).cache()
    df.count()
    for n in (10, 10_000):
        streets = [(c, k, names[k], 1 + k % 3) for c in cities for k in range(n)]
        listed = spark.createDataFrame(streets, STREETS).cache()
        listed.count()
        for _ in range(2):
            t0 = time.time()
            got = geo.detect_street_long_lists(df, listed).select("page_id", "street", "tier").collect()
            taken[n] = time.time() - t0
        where = {name: k for k, name in enumerate(names)}
        for r, page in zip(sorted(got), pages):
            places = [where[f"{a} street"] for a in page[2].split(" words")[0].removesuffix(" street").split(" street ")]
            place = min((p for p in places if p < n), default=None)
            assert r.street == (None if place is None else names[place])
    assert taken[10_000] < 4 * taken[10] + 3


def test_plan(spark, small):
    found_ = geo.detect_street_long_lists(frame(spark, small, "contents"), frame(spark, small, "streets"))
    plan = found_._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "SortMergeJoin" not in plan and "BatchEvalPython" not in plan


def test_beyond_the_bound_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(geo, "is_small", lambda *a: False)
    pages, streets = [(1, "x", "A Road"), (2, None, "b")], [("x", 1, "a road", 2)]
    assert found(spark, pages, streets) == plain(pages, streets)
