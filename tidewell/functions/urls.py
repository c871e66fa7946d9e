"""URL functions as column expressions; what does not parse is null or empty."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Query parameters that only track (fixed list).
TRACKING = "(?i)^(utm_.*|ref|fbclid|gclid|mc_cid|mc_eid)$"


def host_of(url: Column) -> Column:
    """The lower-cased host, '' where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def segments(url: Column) -> Column:
    """The non-empty path segments."""
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    return F.filter(F.split(path, "/"), lambda s: s != "")


def normalize_url(url: Column) -> Column:
    """X4 for absolute URLs: no fragment, no tracking parameters, sorted query, no trailing slash."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), host_of(url)
    port = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")), r"(:\d+)$", 1)
    port = F.when(port.isin(":80", ":443"), "").otherwise(port)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(scheme.isNotNull() & (host != ""), F.concat(scheme, F.lit("://"), host, port, path, tail))


@F.pandas_udf(StringType())
def resolve(url: pd.Series, base: pd.Series) -> pd.Series:
    """Relative references against their page, which no built-in function does."""
    return pd.Series([urljoin(b or "", u) if u else None for u, b in zip(url, base)])


def domain_signature(url: Column, kind: str = "listing") -> Column:
    """Host, kind and the first two segments; those with a digit or over 24 characters are *."""
    if kind == "article":
        return F.concat(host_of(url), F.lit(":article"))
    parts = F.transform(segments(url), lambda s: F.when(s.rlike(r"\d") | (F.length(s) > 24), "*").otherwise(s))
    return F.concat(host_of(url), F.lit(f":{kind}:/"), F.array_join(F.slice(parts, 1, 2), "/"))


def is_github(url: Column) -> Column:
    """X21."""
    return host_of(url).isin("github.com", "www.github.com")


def is_repository_root(url: Column) -> Column:
    """Exactly owner and repository."""
    return is_github(url) & (F.size(segments(url)) == 2)


def releases_url(url: Column) -> Column:
    """The release listing of a repository root, else null."""
    return F.when(is_repository_root(url), F.concat(F.lit("https://github.com/"), F.array_join(segments(url), "/"), F.lit("/releases")))


def is_pdf(url: Column) -> Column:
    """X37."""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")).rlike(r"(?i)\.pdf$")


def is_download_error(message: Column) -> Column:
    """X37."""
    return F.coalesce(message, F.lit("")).rlike("(?i)download is starting|net::ERR_ABORTED")


def is_well_formed(url: Column) -> Column:
    """FL23: false where an encoded space is glued before a parameter name."""
    return ~F.coalesce(url, F.lit("")).rlike(r"%20[A-Za-z_]+=")
