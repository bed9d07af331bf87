"""Changes to stored tables, as DataFrame -> DataFrame steps; ``sources.store`` writes the results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.operators.analytics import city_stats
from leadloom.operators.clients import profile_text
from leadloom.operators.common import pg_order, top_per_key
from leadloom.schemas import STATUSES
from leadloom.sizing import bounded_broadcast

#: Statuses of a stored prospect start with this one.
FIRST_STATUS = "new"
#: Domains of a city that a report lists.
LISTED = 25


def with_store_keys(candidates: DataFrame) -> DataFrame:
    city = F.coalesce(keys.city_key("city"), F.lit(""))
    return candidates.withColumns(
        {
            "city": city,
            "domain": keys.store_domain("website_url"),
            "id": keys.prospect_id(keys.store_url_key("website_url"), city),
        }
    )


def exists_in_store(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates whose domain is already stored for their city."""
    return candidates.join(existing.select("domain", "city"), ["domain", "city"], "left_semi")


def stored_domains(prospects: DataFrame, city: str | None = None) -> DataFrame:
    rows = prospects.filter(F.col("city") == city.lower().strip()) if city else prospects
    return rows.select("city", "domain").distinct()


def only_cities_of(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Restrict the store to the batch's cities, so that only their partitions are read.

    A semi join on the partition column: dynamic partition pruning leaves the other folders unread, however
    many cities there are.
    """
    return existing.join(bounded_broadcast(touched_cities(batch)), "city", "left_semi")


def touched_cities(rows: DataFrame) -> DataFrame:
    """Distinct cities. The comparison holds for every text; it tells the optimizer that the set is a selection,
    without which it does not prune partitions by it."""
    return rows.select("city").distinct().filter(F.col("city") >= "")


def new_prospects(
    candidates: DataFrame, existing: DataFrame, order: Sequence[str | Column] = ("pos",)
) -> DataFrame:
    """First candidate per city and domain that the store does not hold yet.

    Both steps use the key (city, domain): the anti join reuses the partitioning of the first.
    """
    first = top_per_key(with_store_keys(candidates), ["city", "domain"], list(order))
    return first.join(existing.select("city", "domain"), ["city", "domain"], "left_anti")


def qualify_batch(
    candidates: DataFrame, existing: DataFrame, score: Callable[[DataFrame], DataFrame],
    order: Sequence[str | Column] = ("pos",),
) -> DataFrame:
    """New prospects with their scores; running it again after saving returns nothing."""
    found = new_prospects(candidates, existing, order).withColumn("status", F.lit(FIRST_STATUS))
    return found.transform(score)


def batch_report(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per city: candidates, newly saved, skipped as duplicates."""
    seen = existing.select("city", "domain").distinct().withColumn("known", F.lit(True))
    per_domain = with_store_keys(candidates).groupBy("city", "domain").agg(F.count("*").alias("n"))
    return (
        per_domain.join(seen, ["city", "domain"], "left")
        .groupBy("city")
        .agg(F.sum("n").alias("candidates"), F.count_if(F.col("known").isNull()).alias("new_saved"))
        .withColumn("duplicates_skipped", F.col("candidates") - F.col("new_saved"))
    )


def save_report(
    candidates: DataFrame, existing: DataFrame, saved: DataFrame, limit: int = LISTED, id_col: str = "id"
) -> DataFrame:
    """Per city of the batch what was saved, the city's statistics afterwards, and its listing: the first
    ``limit`` domains with their best stored score, in domain order.

    ``existing`` is the store before, ``saved`` the scored rows that were added. A city sends at most ``limit``
    rows per task to its listing.
    """
    columns = ["city", "domain", id_col, F.col("final_score").cast("int").alias("final_score")]
    cities = with_store_keys(candidates.select("city", "website_url"))
    after = only_cities_of(existing.select(columns).unionByName(saved.select(columns)), cities)
    best = top_per_key(after, ["city", "domain"], [pg_order("final_score", True), F.col(id_col)])
    listed = top_per_key(best, ["city"], ["domain"], limit).groupBy("city").agg(
        F.array_sort(F.collect_list(F.struct("domain", "final_score"))).alias("prospects")
    )
    return (
        batch_report(candidates, existing).join(city_stats(after), "city", "left").join(listed, "city", "left")
        .withColumn("total_for_city", F.size("prospects"))
    )


def insert_or_ignore(
    table: DataFrame, additions: DataFrame, key: str, order: Sequence[str | Column]
) -> DataFrame:
    """The table plus the first addition of each key it lacks."""
    first = top_per_key(additions, [key], list(order))
    new = first.join(table.select(key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def suppress(suppression: DataFrame, requests: DataFrame, order: Sequence[str] = ("request_no",)) -> DataFrame:
    """Add opt-outs under their normalized domain; a listed domain keeps its first reason."""
    keyed = requests.withColumn("domain", keys.domain_key("domain")).withColumn(
        "reason", F.coalesce("reason", F.lit("Unsubscribed"))
    )
    return insert_or_ignore(suppression, keyed, "domain", order)


def upsert(
    table: DataFrame, incoming: DataFrame, key: str, overwrite: Sequence[str],
    now: Column | None = None,
) -> DataFrame:
    """Insert new keys; for known keys overwrite only ``overwrite`` (and ``updated_at`` when ``now`` is given).

    One full outer join on the unique key.
    """
    old, new = table.alias("o"), incoming.alias("n")
    joined = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    is_old, is_new = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"o.{c}", f"n.{c}")
        if c == "updated_at" and now is not None:
            return F.when(is_old & is_new, now).when(is_old, F.col(f"o.{c}")).otherwise(
                F.col(f"n.{c}") if c in incoming.columns else now
            )
        if c not in incoming.columns:
            return F.col(f"o.{c}")
        if c in overwrite:
            return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        return F.when(is_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))

    return joined.select(*[value(c).alias(c) for c in table.columns])


def update_status(
    prospects: DataFrame, changes: DataFrame, order: str = "change_no", now: Column | None = None
) -> DataFrame:
    """Apply the last valid change per id; its notes replace the old ones even when they are null."""
    valid = changes.filter(F.col("status").isin(*STATUSES))
    last = top_per_key(valid, ["id"], [F.col(order).desc()]).select(
        "id", F.col("status").alias("new_status"), F.col("notes").alias("new_notes"),
        F.lit(True).alias("changed"),
    )
    hit = F.col("changed").isNotNull()
    columns = {
        "status": F.when(hit, F.col("new_status")).otherwise(F.col("status")),
        "notes": F.when(hit, F.col("new_notes")).otherwise(F.col("notes")),
    }
    if now is not None:
        columns["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    return (
        prospects.join(last, "id", "left").withColumns(columns).drop("new_status", "new_notes", "changed")
    )


def rejected_changes(changes: DataFrame) -> DataFrame:
    """Changes with an unknown status."""
    return changes.filter(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)))


def delete_ids(prospects: DataFrame, ids: DataFrame) -> DataFrame:
    return prospects.join(ids.select("id"), "id", "left_anti")


def delete_cities(prospects: DataFrame, cities: DataFrame) -> DataFrame:
    gone = cities.select(keys.city_key("city").alias("city")).distinct()
    return prospects.join(bounded_broadcast(gone), "city", "left_anti")


def deleted_per_city(prospects: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows to be removed per city asked for, 0 included."""
    asked = cities.select(keys.city_key("city").alias("city")).distinct()
    counts = prospects.groupBy("city").agg(F.count("*").alias("n"))
    return asked.join(counts, "city", "left").select("city", F.coalesce("n", F.lit(0)).alias("deleted"))


def refresh_clients(stored: DataFrame, source: DataFrame, force: bool = False) -> DataFrame:
    """Keep the stored clients when they are complete, else (or when forced) take the source.

    Forced: the source replaces everything. Otherwise the source is upserted by id.
    """
    with_text = source.withColumn("profile_text", profile_text())
    if force:
        return with_text.select(*stored.columns)
    if stored.count() >= source.count():
        return stored
    return upsert(
        stored, with_text.select(*stored.columns), "id",
        [c for c in ("name", "profile_text", "embedding") if c in stored.columns],
    )


def promote_converted(clients: DataFrame, prospects: DataFrame) -> DataFrame:
    """Converted prospects join the clients, so that later scoring compares with them."""
    won = prospects.filter(F.col("status") == "converted").select(
        "id", "name", "country", "country_code", "city", "store_count", "brand_style",
        "business_model",
        profile_text("avg_suit_price_eur", None).alias("profile_text"),
    )
    return insert_or_ignore(clients, won, "id", ["id"])


def with_insert_defaults(prospects: DataFrame, now: Column | None = None) -> DataFrame:
    """Defaults of the prospects table for columns a new row lacks."""
    have = set(prospects.columns)
    empty_list = F.array().cast("array<string>")

    def value(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    moment = now if now is not None else F.current_timestamp()
    texts = {"country": "Unknown", "country_code": "XX", "brand_style": "unknown",
             "business_model": "unknown", "company_overview": "", "detailed_description": "",
             "location_quality": "standard", "most_similar_client": "N/A",
             "similarity_explanation": "", "name": "Unknown"}
    numbers = ("store_count", "quality_score", "similarity_score", "location_score", "final_score",
               "fit_score")
    null_text = F.lit(None).cast("string")
    return prospects.withColumns(
        {
            **{c: value(c, F.lit(d)) for c, d in texts.items()},
            **{c: value(c, F.lit(0)).cast("int") for c in numbers},
            **{c: value(c, F.lit(False)) for c in ("made_to_measure", "heritage_brand")},
            **{c: value(c, empty_list)
               for c in ("store_locations", "material_composition", "sustainability_certs")},
            "avg_suit_price_eur": value("avg_suit_price_eur", F.lit(0.0)),
            "status": value("status", F.lit(FIRST_STATUS)),
            "notes": F.col("notes") if "notes" in have else null_text,
            "discovered_at": moment,
            "updated_at": moment,
        }
    )

