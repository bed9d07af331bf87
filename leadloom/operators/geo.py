"""Premium street detection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.functions.automaton import WordFinder
from leadloom.functions.exprs import as_col, let
from leadloom.sizing import bounded_broadcast, is_small

# Points per street tier.
TIER_POINTS = ((1, 10), (2, 7), (3, 4))


#: Streets, and bytes of them, up to which every task may hold the automata of all cities it meets.
AUTOMATA_MAX_ROWS, AUTOMATA_MAX_BYTES = 500_000, 16 << 20


def _street_lists(streets: DataFrame) -> DataFrame:
    """(city_key, streets): each city's ordered list; ties of position by name, then tier."""
    listed = streets.filter(F.col("street").isNotNull()).select(keys.city_key("city").alias("city_key"), "pos", "street", "tier")
    return listed.groupBy("city_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "street", "tier"))).alias("streets")
    )


def detect_street(
    contents: DataFrame, streets: DataFrame, id_cols: Sequence[str] = (), text: str = "content",
    small: bool | None = None,
) -> DataFrame:
    """Add the first listed street of the page's city whose name occurs in the text.

    The streets of a city travel as one ordered list (ties of position by name, then tier), and every page is
    matched in its own row: no match pairs, no identity of pages, no regrouping of texts. Whether the lists are
    broadcast or joined by a shuffle on the city (``small`` decides it for them) changes no result.
    """
    per_city = _street_lists(streets)
    if small is None:
        per_city = bounded_broadcast(per_city)
    elif small:
        per_city = F.broadcast(per_city)
    first = let(
        F.lower(F.coalesce(as_col(text), F.lit(""))),
        lambda t: F.get(F.filter("streets", lambda s: F.contains(t, s["street"])), F.lit(0)),
    )
    return (
        contents.withColumn("city_key", keys.city_key("city"))
        .join(per_city, "city_key", "left")
        .withColumn("hit", first)
        .withColumn("street", F.col("hit.street"))
        .withColumn("tier", F.col("hit.tier"))
        .drop("city_key", "streets", "hit")
    )


def detect_street_long_lists(contents: DataFrame, streets: DataFrame, text: str = "content") -> DataFrame:
    """The same columns as :func:`detect_street`, for cities with many streets.

    A city's streets are one automaton, built when a task first meets the city, and a text is read once whatever
    the length of the list; the list's order decides among the streets that occur. Only the city and the lower-cased
    text of pages whose city is listed go to Python, and only the hit comes back. The street table is measured:
    beyond the bound the lists are joined by a shuffle and tried one by one.
    """
    lists = _street_lists(streets)
    flat = streets.select("street")
    if not is_small(flat, AUTOMATA_MAX_ROWS, AUTOMATA_MAX_BYTES):
        return detect_street(contents, streets, text=text, small=False)
    rows = lists.select("city_key", F.col("streets.street").alias("street"), F.col("streets.tier").alias("tier")).collect()
    known = contents.sparkSession.sparkContext.broadcast({r.city_key: (r.street, r.tier) for r in rows})

    @F.pandas_udf("street string, tier int")
    def hit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        finders: dict[str, WordFinder] = {}
        for cities, texts in batches:
            found = []
            for city, body in zip(cities, texts):
                if body is None:
                    found.append((None, None))
                    continue
                if city not in finders:
                    finders[city] = WordFinder(known.value[city][0])
                place = finders[city].first(body)
                found.append((None, None) if place is None else tuple(column[place] for column in known.value[city]))
            street, tier = zip(*found) if found else ((), ())
            yield pd.DataFrame({"street": pd.Series(street, dtype="object"), "tier": pd.Series(tier, dtype="Int32")})

    listed = F.broadcast(lists.select("city_key", F.lit(True).alias("_listed")))  # no more rows than the measured table
    body = F.when(F.col("_listed"), F.lower(F.coalesce(as_col(text), F.lit(""))))
    return (
        contents.withColumn("city_key", keys.city_key("city"))
        .join(listed, "city_key", "left")
        .withColumn("_hit", hit(F.col("city_key"), body))
        .withColumn("street", F.col("_hit.street"))
        .withColumn("tier", F.col("_hit.tier").cast(streets.schema["tier"].dataType))
        .drop("city_key", "_listed", "_hit")
    )


def location_score(tier: Column | str) -> Column:
    t = as_col(tier)
    points = None
    for n, p in TIER_POINTS:
        points = F.when(t == n, p) if points is None else points.when(t == n, p)
    return points.otherwise(0)


def location_quality(street: Column | str, given: Column | str | None = None) -> Column:
    other = F.lit("standard") if given is None else F.coalesce(as_col(given), F.lit("standard"))
    return F.when(as_col(street).isNotNull(), "premium").otherwise(other)


def with_location(contents: DataFrame, given: str | None = None) -> DataFrame:
    return contents.withColumn("location_score", location_score("tier")).withColumn(
        "location_quality", location_quality("street", given)
    )


def supported_cities(streets: DataFrame) -> DataFrame:
    return streets.select("city").distinct()


def in_supported_city(rows: DataFrame, streets: DataFrame) -> DataFrame:
    listed = bounded_broadcast(supported_cities(streets).select(keys.city_key("city").alias("listed")))
    return rows.join(listed, keys.city_key("city") == F.col("listed"), "left_semi")
