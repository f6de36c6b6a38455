"""Addresses, urls and text pieces."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

IPV4 = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
ZONED = r"(Z|[+-]\d\d:?\d\d)$"


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return str(a.ipv4_mapped) if a.version == 6 and a.ipv4_mapped else str(a)

    return texts.map(one, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def is_global_ip(texts: pd.Series) -> pd.Series:
    def one(t):
        try:
            return ipaddress.ip_address(t).is_global
        except ValueError:
            return False

    return texts.map(one, na_action="ignore").astype("boolean")


def bare_ip(text: Column) -> Column:
    """Without quotes, brackets and port."""
    t = F.regexp_replace(F.trim(text), "^\"+|\"+$", "")
    return F.when(F.startswith(t, F.lit("[")), F.regexp_extract(t, r"^\[([^\]]+)\]", 1)).when(t.rlike(r"^\d+\.\d+\.\d+\.\d+:\d+$"), F.substring_index(t, ":", 1)).otherwise(t)


def canonical_ip(text: Column) -> Column:
    """One spelling for each address, null for anything else. Plain IPv4 is not parsed in Python: it gets nulls, as it is asked for all rows."""
    t = F.nullif(bare_ip(text), F.lit(""))
    return F.when(t.rlike(IPV4), t).otherwise(_canonical(F.when(t.contains(":"), t)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _canonical_all(lists: pd.Series) -> pd.Series:
    def one(t):
        try:
            a = ipaddress.ip_address(t)
        except ValueError:
            return None
        return str(a.ipv4_mapped) if a.version == 6 and a.ipv4_mapped else str(a)

    return lists.map(lambda x: [one(t) for t in x], na_action="ignore")


def canonical_ips(texts: Column) -> Column:
    """canonical_ip of each element."""
    return _canonical_all(F.transform(texts, bare_ip))


def utc(text: Column) -> Column:
    """A timestamp from text with a zone; text without one gives null."""
    return F.when(text.rlike(ZONED), text.try_cast("timestamp"))


def dash_null(text: Column) -> Column:
    t = F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.nullif(F.nullif(t, F.lit("-")), F.lit(""))


def path_and_query(target: Column) -> Column:
    """Of an absolute url or a request target; without fragment; a leading // stays."""
    bare = F.substring_index(target, "#", 1)
    return F.when(bare.rlike("(?i)^https?://"), F.coalesce(F.nullif(F.regexp_extract(bare, "(?i)^https?://[^/?]*(.*)$", 1), F.lit("")), F.lit("/"))).otherwise(bare)


def key_values(text: Column) -> Column:
    """A map of k=v pairs; the first of a repeated key counts; quotes around values go."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(r"(\w[\w-]*=(?:\"[^\"]*\"|'[^']*'|\S*))"), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(p, r"^[^=]*=", ""), "^[\"']|[\"']$", "").alias("v")))
    first = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, 1, i), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(first)


def unhex_text(text: Column) -> Column:
    """Text of an even run of hex digits; anything else as it is."""
    return F.when(text.rlike("^(?:[0-9A-Fa-f]{2})++$"), F.coalesce(F.regexp_replace(F.decode(F.unhex(text), "UTF-8"), "\\x00", " "), text)).otherwise(text)


def message_shape(text: Column) -> Column:
    """A message with its addresses, hex strings and numbers masked."""
    t = F.regexp_replace(text, r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>")
    return F.regexp_replace(F.regexp_replace(t, r"\b(0x)?[0-9a-fA-F]{8,}\b", "<hex>"), r"\d+", "<n>")
