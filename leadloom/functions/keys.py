"""URL, domain and city keys.

Two families exist on purpose. The *discovery* keys drop a scheme and ``www.`` only at the start of the
URL; the *store* keys drop them wherever they occur. They give different keys for odd URLs, so each
job must keep using its own family.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.exprs import as_col, strip

SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"


def _without_tail(u: Column) -> Column:
    """Trailing slashes first, then the query string, then the fragment: the order is visible
    (``a.com/?x`` keeps its slash)."""
    u = F.rtrim(u, F.lit("/"))
    return F.substring_index(F.substring_index(u, "?", 1), "#", 1)


def discovery_url_key(url: Column | str) -> Column:
    u = F.regexp_replace(strip(F.lower(as_col(url))), r"^(?:https?://)?(?:www\.)?", "")
    return F.coalesce(_without_tail(u), F.lit(""))


def store_url_key(url: Column | str) -> Column:
    u = strip(F.lower(as_col(url)))
    for token in ("https://", "http://", "www."):
        u = F.replace(u, F.lit(token), F.lit(""))
    return F.coalesce(_without_tail(u), F.lit(""))


def authority(url: Column | str) -> Column:
    """``host[:port]`` as written; empty when the URL has no scheme marker."""
    return F.coalesce(F.regexp_extract(strip(url), SCHEME + r"([^/?#]*)", 1), F.lit(""))


def discovery_domain(url: Column | str) -> Column:
    """Authority with its letter case and port, less one leading ``www.``."""
    return F.coalesce(
        F.regexp_extract(strip(url), SCHEME + r"(?:www\.)?([^/?#]*)", 1), F.lit("")
    )


def store_domain(url: Column | str) -> Column:
    return F.substring_index(store_url_key(url), "/", 1)


def city_key(city: Column | str) -> Column:
    return strip(F.lower(as_col(city)))


def domain_key(domain: Column | str) -> Column:
    """Key of a suppression entry."""
    return strip(F.lower(as_col(domain)))


def prospect_id(url_key: Column, city: Column) -> Column:
    return F.substring(F.md5(F.concat(url_key, F.lit("_"), city).cast("binary")), 1, 16)


def host(url: Column | str) -> Column:
    """Lower-case host without user info and port."""
    bare = F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", "")
    return F.lower(bare)


def contact_host(url: Column | str) -> Column:
    return F.replace(host(url), F.lit("www."), F.lit(""))
