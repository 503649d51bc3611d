"""Native URL functions. A URL that can't be used gives null where an exception would stop a job."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Query parameters that only track, in lower case.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "igshid", "mc_cid", "mc_eid"]
_PARTS = r"(?i)^[\x00-\x20]*(https?):/*([^/?#\\]+)([^?#]*)(?:\?([^#]*))?"


def is_http_url(url):
    return F.coalesce(F.regexp_like(url, F.lit(r"(?i)^[\x00-\x20]*https?:/*[^/?#\\\s]")), F.lit(False))


def display_link(url):
    """Host name of any URL with an authority, without port and user; empty if there is none."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.coalesce(F.lower(host), F.lit(""))


def _decoded(part):
    return F.coalesce(F.try_url_decode(part), part)


def normalize_url(url):
    """The canonical form that keys the store, or null if the URL isn't http(s).

    Scheme and host in lower case, default port, fragment and tracking parameters dropped, parameters
    sorted by name, slashes collapsed, no slash at the end. Of a repeated name every place has the
    first value.
    """
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    scheme, authority = F.lower(part(1)), part(2)
    user = F.regexp_extract(authority, "^(.*@)?", 0)
    site = F.lower(F.regexp_replace(authority, "^.*@", ""))
    site = F.regexp_replace(site, F.when(scheme == "http", ":(80)?$").otherwise(":(443)?$"), F.lit(""))
    path = F.regexp_replace(F.translate(part(3), "\\", "/"), "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise("/")
    pairs = F.transform(
        F.filter(F.split(part(4), "&"), lambda p: p != ""),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.instr(p, "=") > 0, F.substr(p, F.instr(p, "=") + 1)).otherwise("")).alias("v")),
    )
    pairs = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING_PARAMS))
    # one array of distinct names, sorted; each is written as often as it occurs, with its first value
    names = F.array_sort(F.transform(pairs, lambda p: p["k"]))
    query = F.array_join(F.transform(names, lambda n: F.concat(F.url_encode(n), F.lit("="), F.url_encode(F.get(F.filter(pairs, lambda p: p["k"] == n), F.lit(0))["v"]))), "&")
    full = F.concat(scheme, F.lit("://"), user, site, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(is_http_url(url), full)
