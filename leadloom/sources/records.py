"""Mappings between stored rows, older layouts, nested search results and API records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.exprs import as_col, blank_to, strip
from leadloom.schemas import LIST, OUTREACH_LOG

EUR_USD = 1.08

# Text shown for a missing overview.
NO_OVERVIEW = "Informação não disponível"


def lenient_int(c: Column | str, kind: T.DataType | None = None) -> Column:
    """Integer text, else 0; a column that is numeric already is cut to its integer part."""
    if isinstance(kind, T.NumericType):
        return F.coalesce(as_col(c).try_cast("int"), F.lit(0))
    return F.coalesce(strip(as_col(c).cast("string")).try_cast("int"), F.lit(0))


def score_int(c: Column | str) -> Column:
    """A score as the table stores it: any number cut to its integer part, else 0."""
    return F.coalesce(strip(as_col(c).cast("string")).try_cast("double").try_cast("int"), F.lit(0))


def json_list(c: Column | str) -> Column:
    """A JSON array of strings; anything else is the empty list."""
    return F.coalesce(F.from_json(as_col(c), LIST), F.array().cast(LIST))


def read_legacy_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def import_legacy(rows: DataFrame) -> DataFrame:
    """Rows of the older layout in the current types."""
    have = set(rows.columns)
    scores = [c for c in ("quality_score", "similarity_score", "location_score", "final_score") if c in have]
    lists = [c for c in ("material_composition", "sustainability_certs", "store_locations") if c in have]
    return rows.withColumns(
        {
            **({"store_count": lenient_int("store_count", rows.schema["store_count"].dataType)} if "store_count" in have else {}),
            **{c: score_int(c) for c in scores},
            **{c: json_list(c) for c in lists},
            "status": F.coalesce("status", F.lit("new")) if "status" in have else F.lit("new"),
        }
    )


def import_log(rows: DataFrame) -> DataFrame:
    """Outreach lines of the older layout, where everything is text: a column that is missing is null, as is a
    time that cannot be read."""
    have = set(rows.columns)

    def value(f: T.StructField) -> Column:
        return F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)

    return rows.select(*[value(f).alias(f.name) for f in OUTREACH_LOG.fields])


def flatten_results(nested: DataFrame, results: str = "results") -> DataFrame:
    """One row per hit of each query call, with its rank."""
    keep = [c for c in nested.columns if c != results]
    return nested.select(*keep, F.posexplode(results).alias("rank", "hit")).select(*keep, "rank", "hit.*")


# The wording of the lines below.
def _log(rows: DataFrame) -> Column:
    """Lines that say how a prospect was rated."""
    points = F.col("final_score").cast("decimal(10,1)").cast("string")
    lines = [
        F.concat(F.lit("Pontuação: "), points, F.lit("/100")),
        F.concat(F.lit("Similar a: "), blank_to("most_similar_client", F.lit("N/D"))),
    ]
    if "similarity_explanation" in rows.columns:
        why = F.col("similarity_explanation")
        lines.append(F.when(why != "", F.concat(F.lit("Explicação: "), why)))
    return F.array_compact(F.array(*lines))


def api_records(rows: DataFrame, rate: float = EUR_USD) -> DataFrame:
    """Stored rows (lists as JSON text) as the records an API or page shows."""
    price = F.coalesce("avg_suit_price_eur", F.lit(0.0))
    score = F.coalesce("location_score", F.lit(0))
    return rows.select(
        "id",
        "name",
        F.col("website_url").alias("websiteUrl"),
        F.col("store_count").alias("storeCount"),
        (price * rate).alias("averageSuitPriceUSD"),
        "city",
        F.col("country").alias("originCountry"),
        F.coalesce(F.col("status") != "new", F.lit(True)).alias("verified"),
        (price > 0).alias("priceKnown"),
        _log(rows).alias("verificationLog"),
        F.col("brand_style").alias("brandStyle"),
        F.col("business_model").alias("businessModel"),
        blank_to("company_overview", F.lit(NO_OVERVIEW)).alias("companyOverview"),
        F.coalesce("detailed_description", F.lit("")).alias("detailedDescription"),
        json_list("store_locations").alias("storeLocations"),
        blank_to("location_quality", F.when(score > 0, "premium").otherwise("standard")).alias(
            "locationQuality"
        ),
        score.alias("locationScore"),
        F.coalesce("fit_score", F.lit(0)).alias("fitScore"),
        F.get(json_list("material_composition"), F.lit(0)).alias("woolPercentage"),
        F.coalesce("made_to_measure", F.lit(False)).alias("madeToMeasure"),
    )
