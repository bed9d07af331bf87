"""Order-dependent, fuzzy removal of repeated leads within a city.

Walking the leads of a city in order, a lead goes when its URL or domain is blank, its domain was seen on
a kept lead, or its name (lower case, stripped) contains or is contained in the name of a kept lead.

Two exact forms: a fold over lists of bounded length, and passes over growing stretches of the walk for groups of any size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.functions.automaton import WordFinder
from leadloom.functions.exprs import as_col, strip
from leadloom.operators.common import top_per_key
from leadloom.sizing import bounded_broadcast, checkpointed, stored

FOLD_LIMIT = 200
#: Leads of a city that are walked in the first pass, and at most in any; characters of names in a pass and in a group.
FIRST_STRETCH, LONGEST_STRETCH, STRETCH_CHARS, GROUP_CHARS = 2_000, 200_000, 8_000_000, 8_000_000


def _usable(leads: DataFrame) -> DataFrame:
    """Leads with an address, with the keys of the walk; a null city is a city of its own."""
    keyed = leads.withColumn("domain", keys.discovery_domain("website_url")).withColumn(
        "name_key", strip(F.lower(F.coalesce("name", F.lit(""))))
    )
    return keyed.filter(
        F.col("website_url").isNotNull() & (F.col("website_url") != "") & (F.col("domain") != "")
    )


def _turn(pos: Column, *ties: Column) -> Column:
    """Sorts like the walk: by position, rows without one last, then by the given columns."""
    return F.struct(pos.isNull().alias("late"), F.coalesce(pos.cast("decimal(38,10)"), F.lit(0)).alias("at"), *ties)


def _fold(groups: DataFrame) -> DataFrame:
    """Walk each city's ordered array ``xs`` of (name_key, domain_key, ...); kept elements as ``x``."""

    def step(acc, x):
        clash = F.exists(
            acc,
            lambda s: (s["domain_key"] == x["domain_key"])
            | F.contains(x["name_key"], s["name_key"])
            | F.contains(s["name_key"], x["name_key"]),
        )
        return F.when(clash, acc).otherwise(F.concat(acc, F.array(x)))

    return groups.select("city", F.explode(F.aggregate("xs", F.slice("xs", 1, 0), step)).alias("x"))


def dedupe_finalists(leads: DataFrame, pos: str = "pos", short_lists: bool = False) -> DataFrame:
    """The walk over each city's list. Rows of one position are walked by name, then domain.

    Where the step before keeps every list short, ``short_lists`` makes it one lazy plan that folds a city's
    ordered list in one array. Otherwise it is :func:`dedupe_leads`, for lists of any length.
    """
    if not short_lists:
        return dedupe_leads(leads, pos)
    row = F.struct(*[F.col(c) for c in leads.columns])
    lead = F.struct(
        _turn(as_col(pos), F.col("name_key"), F.col("domain")).alias("turn"), "name_key", F.col("domain").alias("domain_key"),
        row.alias("row"),
    )
    groups = _usable(leads).groupBy("city").agg(F.array_sort(F.collect_list(lead)).alias("xs"))
    return _fold(groups).select("x.row.*")


def dedupe_leads(leads: DataFrame, pos: str = "pos", fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The same walk for groups of any size, row by row.

    Every row gets a number of its own, so repeated positions, ids or whole rows cannot be confused. A repeated
    (domain, name) of a city always goes, so only its first row takes part, as a narrow row of keys. Cities
    with at most ``fold_limit`` such rows are folded; larger ones are walked in stretches, to the same end.
    """
    row = unused_name(leads, "_row")
    numbered = stored(leads.withColumn(row, F.monotonically_increasing_id()))
    turn = _turn(as_col(pos), F.col("name_key"), F.col("domain"), F.col(row))
    work = _usable(numbered).select(
        F.coalesce(F.concat(F.lit("="), F.col("city").cast("string")), F.lit("")).alias("city"), "domain", "name_key", turn.alias("p"),
    )
    work = checkpointed(top_per_key(work, ["city", "domain", "name_key"], ["p"]))
    sizes = checkpointed(work.groupBy("city").agg(F.count("*").alias("n")))
    few = work.join(sizes.filter(F.col("n") <= fold_limit).select("city"), "city", "left_semi")
    item = F.struct("p", "name_key", F.col("domain").alias("domain_key"))
    folded = _fold(few.groupBy("city").agg(F.array_sort(F.collect_list(item)).alias("xs")))
    survivors = folded.select(F.col(f"x.p.{row}").alias(row))
    many = work.join(sizes.filter(F.col("n") > fold_limit).select("city"), "city", "left_semi")
    for kept in _stretches(many.withColumn("row", F.col(f"p.{row}"))):
        survivors = survivors.union(kept.select(F.col("row").alias(row)))
    return numbered.join(survivors, row, "left_semi").drop(row)


def unused_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The kept rows of one stretch of a city's walk (city, turn, domain, name_key, row), in which all that clashes with
    earlier stretches is gone already."""
    rows = rows.sort_values("turn")
    names = list(dict.fromkeys(rows["name_key"]))
    finder, place = WordFinder(names), {name: k for k, name in enumerate(names)}
    domains: set[str] = set()
    kept_names: set[int] = set()
    inside_kept: set[int] = set()  # names that a kept name contains, itself included
    kept = []
    for domain, name in zip(rows["domain"], rows["name_key"]):
        stays = domain not in domains and place[name] not in inside_kept
        if stays:
            inside = finder.all(name)
            stays = kept_names.isdisjoint(inside)
        if stays:
            domains.add(domain)
            kept_names.add(place[name])
            inside_kept |= inside
        kept.append(stays)
    return rows.loc[kept, ["city", "domain", "name_key", "row"]]


def _clashing(names: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """The names (city, name_key) of a group that contain a kept name or lie in one."""
    own, other = list(names["name_key"]), list(kept["name_key"])
    if not own or not other:
        return names.iloc[:0][["city", "name_key"]]
    within, around = WordFinder(own), WordFinder(other)
    hit = {k for name in other for k in within.all(name)}
    return names.loc[[k in hit or around.any(name) for k, name in enumerate(own)], ["city", "name_key"]]


def _stretches(work: DataFrame) -> list[DataFrame]:
    """Kept rows (city, domain, name_key, row) of groups of any size, one frame per pass. ``work`` has each name of a
    domain once per city.

    A pass walks the next stretch of every city, in one task per city; a stretch is bounded in rows and characters, and
    twice as long as the one before up to that bound. All later leads that clash with what the stretch has kept
    then go at once: by domain through a join, by name through two automata per group of names, one of the kept
    names and one of the group's own, each run once over the other's characters. So the number of passes depends
    on the number of leads that stay in question, not on how clashes chain, and no name is taken apart.
    """
    passes: list[DataFrame] = []
    undecided, longest = checkpointed(work), FIRST_STRETCH
    while not undecided.isEmpty():
        order = Window.partitionBy("city").orderBy("p")
        first = top_per_key(undecided, ["city"], ["p"], k=longest, rank_name="turn")
        ahead = F.sum(F.length("name_key")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        first = first.withColumn("ahead", F.coalesce(ahead, F.lit(0))).filter(F.col("ahead") <= STRETCH_CHARS).drop("ahead")
        first = checkpointed(first)
        kept = checkpointed(
            first.select("city", "turn", "domain", "name_key", "row").groupBy("city")
            .applyInPandas(_walk, "city string, domain string, name_key string, row long")
        )
        passes.append(kept)
        last = bounded_broadcast(first.groupBy("city").agg(F.max("p").alias("last")))
        rest = undecided.join(last, "city").filter(F.col("p") > F.col("last")).drop("last")
        rest = checkpointed(rest.join(kept.select("city", "domain"), ["city", "domain"], "left_anti"))
        names = rest.select("city", "name_key").distinct()
        groups = names.groupBy("city").agg((F.floor(F.sum(F.length("name_key") + 1) / GROUP_CHARS) + 1).cast("long").alias("groups"))
        groups = bounded_broadcast(checkpointed(groups))
        names = names.join(groups, "city").withColumn("g", F.pmod(F.xxhash64("name_key"), F.col("groups"))).drop("groups")
        others = kept.select("city", "name_key").join(groups, "city")
        others = others.select("city", "name_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
        clashing = names.groupBy("city", "g").cogroup(others.groupBy("city", "g")).applyInPandas(
            _clashing, "city string, name_key string"
        )
        undecided = checkpointed(rest.join(clashing, ["city", "name_key"], "left_anti"))
        longest = min(2 * longest, LONGEST_STRETCH)
    return passes
