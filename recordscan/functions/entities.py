"""Entities in a text: mail addresses, hosts, URLs, IP addresses, UUIDs and digests."""

from __future__ import annotations

import ipaddress
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The shapes of entities, in the order that breaks ties of place.
EMAIL = r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
URL = r"""https?://[^\s<>"']+"""
ADDRESS = r"(?<![\w:.])[0-9A-Fa-f:.]{3,}(?![\w:.])"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
DIGEST = r"\b[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?\b"
DIGESTS = {32: "md5", 40: "sha1", 64: "sha256"}
URL_TAIL = ".,;:!?)]"


def _address(found: str) -> list[tuple[str, str]]:
    try:
        ip = ipaddress.ip_address(found)
    except ValueError:
        return []
    return [(f"ipv{ip.version}", str(ip))]


def _mail(found: str) -> list[tuple[str, str]]:
    value = found.casefold()
    return [("email", value), ("domain", value.rpartition("@")[2])]


def _url(found: str) -> list[tuple[str, str]]:
    value = found.rstrip(URL_TAIL)
    try:
        host = urlsplit(value).hostname
    except ValueError:
        host = None
    return [("url", value), *([("domain", host.casefold())] if host else [])]


_KINDS = [
    (re.compile(EMAIL, re.I), _mail), (re.compile(URL, re.I), _url), (re.compile(ADDRESS), _address),
    (re.compile(UUID, re.I), lambda found: [("uuid", str(uuid.UUID(found)))]), (re.compile(DIGEST, re.I), lambda found: [(DIGESTS[len(found)], found.casefold())] if len(found) in DIGESTS else []),
]


def entities_of(text: str) -> list[tuple[str, str]]:
    """(kind, value) of each entity, by place, each pair once."""
    placed = ((m.start(), order, pair) for order, (shape, read) in enumerate(_KINDS) for m in shape.finditer(text) for pair in read(m[0]))
    return list(dict.fromkeys(pair for _, _, pair in sorted(placed, key=lambda x: x[:2])))


_PAIRS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


@F.pandas_udf(_PAIRS)
def entities_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """All entities of a text in order: an Arrow UDF, as addresses and UUIDs are brought to one spelling."""
    for t in texts:
        yield t.map(lambda x: [{"kind": k, "value": v} for k, v in entities_of(x)] if isinstance(x, str) else None)


#: What every entity holds: texts without it have none and stay in the JVM.
SIGNS = r"@|://|\d\.\d+\.\d+\.\d|:[0-9A-Fa-f.]*:|[0-9A-Fa-f]{8}"


def entities(text: Column) -> Column:
    """All entities of a text in order, none of a null text."""
    none = F.when(text.isNotNull(), F.array().cast(_PAIRS))
    return F.coalesce(entities_udf(F.when(text.rlike(SIGNS), text)), none)


def _all(text: Column, shape: str) -> Column:
    return F.regexp_extract_all(text, F.lit(shape), F.lit(0))


def emails(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + EMAIL), F.lower))


def email_domains(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + EMAIL), lambda x: F.lower(F.substring_index(x, "@", -1))))


def urls(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + URL), lambda x: F.regexp_replace(x, r"[.,;:!?)\]]+$", "")))


def url_hosts(text: Column) -> Column:
    hosts = F.transform(urls(text), lambda x: F.lower(F.regexp_extract(x, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)))
    return F.array_distinct(F.filter(hosts, lambda x: x != ""))


def ipv4s(text: Column) -> Column:
    """IPv4 addresses: four numbers up to 255 without leading zeros, not part of a longer run."""
    number = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    return F.array_distinct(_all(text, rf"(?<![\w:.]){number}(?:\.{number}){{3}}(?![\w:.])"))


def uuids(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + UUID), F.lower))


def digests(text: Column) -> Column:
    return F.array_distinct(F.transform(_all(text, "(?i)" + DIGEST), F.lower))


def digest_kind(value: Column) -> Column:
    n = F.length(value)
    return F.when(n == 32, "md5").when(n == 40, "sha1").when(n == 64, "sha256")
