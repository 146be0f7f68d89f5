"""Address predicates that need a parser."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def public(text: str | None) -> bool:
    try:
        a = ipaddress.ip_address((text or "").strip())
    except ValueError:
        return False
    a = getattr(a, "ipv4_mapped", None) or a
    return a.is_global and not a.is_multicast and not a.is_reserved


def _public(addr: pd.Series) -> pd.Series:
    return addr.map(public)


def is_global(addr: str) -> Column:
    return pandas_udf(_public, "boolean")(addr)
