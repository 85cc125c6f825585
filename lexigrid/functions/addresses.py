"""Which network addresses an ingest source or a model's endpoint may have."""

from __future__ import annotations

import ipaddress
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrid.errors import ConfigError

#: Carrier-grade NAT, which the standard library does not call private.
SHARED = ipaddress.ip_network("100.64.0.0/10")


def inner(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> list:
    """The IPv4 addresses that an address carries (mapped, 6to4, Teredo), and then itself."""
    carried = (address.ipv4_mapped, address.sixtofour, *(address.teredo or ())) if address.version == 6 else ()
    return [*(a for a in carried if a is not None), address]


def classify(text: str | None) -> str:
    """public, or why not: invalid, unspecified, loopback, link_local, multicast, shared, private or reserved."""
    try:
        address = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return "invalid"
    for a in inner(address):
        for name, hit in (
            ("unspecified", a.is_unspecified), ("loopback", a.is_loopback), ("link_local", a.is_link_local), ("multicast", a.is_multicast),
            ("shared", a.version == 4 and a in SHARED), ("reserved", a.is_reserved), ("private", a.is_private),
        ):
            if hit:
                return name
    return "public"


def address_class(address: Column) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(classify)

    return run(address)


def check_endpoint(url: str, resolved: list[str], local: bool = False) -> str:
    """A model's base URL without its final slash. Every resolved address must be public; a local provider's may be private or loopback."""
    parts = urlsplit(url)
    if parts.scheme not in {"http", "https"} or not parts.hostname or parts.username or parts.password or parts.query or parts.fragment:
        raise ConfigError("an endpoint is http or https with a host, without userinfo, query and fragment")
    allowed = {"public", "private", "loopback"} if local else {"public"}
    if bad := sorted({c for c in map(classify, resolved) if c not in allowed}) or ([] if resolved else ["unresolved"]):
        raise ConfigError(f"the endpoint's address is {', '.join(bad)}")
    return url.rstrip("/")
