"""URL rules as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "***"
#: Query parameters that carry a credential, in lower case without - and _.
CREDENTIAL_PARAMS = (
    "accesstoken", "apikey", "auth", "authorization", "clientsecret", "credential", "credentials", "idtoken", "key", "password",
    "passwd", "privatekey", "pwd", "refreshtoken", "sastoken", "secret", "sessionid", "sig", "signature", "token",
)
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query; empty if absent."""
    return F.regexp_extract(url, f"(?s){_PARTS}", n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Without userinfo, brackets and port, in lower case."""
    bare = F.regexp_replace(authority(url), r"^.*@", "")
    return F.lower(F.when(bare.startswith("["), F.regexp_extract(bare, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(bare, r":.*$", "")))


def query_names(url: Column) -> Column:
    """Names of the query's parameters in order, decoded."""
    pairs = F.filter(F.split(part(url, 4), "&", -1), lambda x: x != "")
    return F.transform(pairs, lambda x: F.try_url_decode(F.regexp_replace(x, r"(?s)=.*$", "")))


def credential_params(url: Column) -> Column:
    """Those names that carry a credential, as they are spelled."""
    return F.filter(query_names(url), lambda x: F.regexp_replace(F.lower(x), "[-_]", "").isin(*CREDENTIAL_PARAMS))


def refusal(url: Column) -> Column:
    """Why a URL is not ingested: scheme, host, userinfo or credential; null if it may be."""
    return (
        F.when(url.isNull() | ~scheme(url).isin("http", "https"), "scheme")
        .when(host(url) == "", "host")
        .when(authority(url).contains("@"), "userinfo")
        .when(F.size(credential_params(url)) > 0, "credential")
    )


def sanitized(url: Column) -> Column:
    """For messages: no userinfo, no query values, no fragment."""
    names = F.transform(query_names(url), lambda x: F.concat(F.url_encode(x), F.lit("="), F.lit("%2A%2A%2A")))
    bare = F.lower(F.regexp_replace(authority(url), r"^.*@", ""))
    safe = F.when(authority(url).contains("@"), F.concat(F.lit(f"{REDACTED}@"), bare)).otherwise(bare)
    return F.concat(F.when(part(url, 1) != "", F.concat(scheme(url), F.lit("://"))).otherwise(""), safe, part(url, 3), F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))


def is_html(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))).isin("text/html", "application/xhtml+xml")
