"""Outreach batches: who to write to, with which text, and the log of what was sent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions import keys
from leadloom.operators.common import top_per_key
from leadloom.operators.content import lead_price_text
from leadloom.operators.discovery import drop_suppressed

# Wording of the notice.
SUBJECT = "Novo Potencial Cliente: %s"
TEXT = "Novo cliente detetado: %s\nWebsite: %s\nCidade: %s"


def contact(url: Column | str) -> Column:
    return F.concat(F.lit("info@"), F.coalesce(keys.contact_host(url), F.lit("")))


def render(brands: DataFrame) -> DataFrame:
    """Contact, subject, text and shown price of each brand; a narrow projection."""
    usd = (
        F.col("average_suit_price_usd") if "average_suit_price_usd" in brands.columns else F.lit(0.0)
    )
    return brands.withColumns(
        {
            "contact": contact("website_url"),
            "subject": F.format_string(SUBJECT, "name"),
            "body": F.format_string(TEXT, "name", "website_url", "city"),
            "price_text": lead_price_text(F.col("avg_suit_price_eur"), usd),
        }
    )


def outreach_batch(
    prospects: DataFrame, suppression: DataFrame, log: DataFrame,
    order: Sequence[str | Column] = ("id",), done: str = "success",
) -> DataFrame:
    """One message per host that did not opt out and was not written to successfully.

    The batch is cut to one row per host before the anti joins, so these move hosts, not prospects.
    """
    hosts = prospects.withColumn("domain", keys.contact_host("website_url"))
    one = top_per_key(hosts, ["domain"], list(order))
    written = log.filter(F.col("status") == done).select(
        keys.contact_host("website_url").alias("domain")
    )
    open_ = drop_suppressed(one, suppression).join(written, "domain", "left_anti")
    return render(open_)


def log_rows(
    sent: DataFrame, status: Column | None = None, error: Column | None = None, at: Column | None = None
) -> DataFrame:
    """Log entries for a batch, in the log's schema."""
    return sent.select(
        F.col("name").alias("brand_name"),
        "website_url",
        (status if status is not None else F.lit("success")).alias("status"),
        (error if error is not None else F.lit(None)).cast("string").alias("error_message"),
        (at if at is not None else F.current_timestamp()).alias("sent_at"),
    )


def append_log(log: DataFrame, entries: DataFrame) -> DataFrame:
    return log.unionByName(entries)
