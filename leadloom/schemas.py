"""Fixed schemas of the stored tables. No inference anywhere."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B, TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
LIST = T.ArrayType(T.StringType())


def _struct(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols.items()])


PROSPECTS = _struct(
    id=S, name=S, website_url=S, domain=S, country=S, country_code=S, store_count=I,
    avg_suit_price_eur=D, brand_style=S, business_model=S, company_overview=S,
    detailed_description=S, store_locations=LIST, material_composition=LIST,
    sustainability_certs=LIST, made_to_measure=B, heritage_brand=B, quality_score=I,
    similarity_score=I, location_score=I, location_quality=S, final_score=I, fit_score=I,
    most_similar_client=S, similarity_explanation=S, status=S, notes=S, discovered_at=TS,
    updated_at=TS, city=S,
)

OUTREACH_LOG = _struct(brand_name=S, website_url=S, status=S, error_message=S, sent_at=TS)

# The JSON a reviewer or a selection model returns for one brand.
LEAD = _struct(
    name=S, url=S, storeCount=I, avgPrice=D, priceSource=S, woolPercentage=S, madeToMeasure=B,
    brandStyle=S, businessModel=S, detailedDescription=S, storeLocations=LIST, whySelected=S,
    country=S, locationQuality=S, fitScore=I,
)

# The states of a prospect.
STATUSES = ("new", "contacted", "converted", "rejected")
