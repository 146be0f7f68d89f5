"""Addresses and domains as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

_LABEL = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
DOMAIN = rf"^{_LABEL}(\.{_LABEL})+$"


def domain_of(url: Column) -> Column:
    """Host part as written (port and user kept); an address without scheme gives
    its first path segment if that has a dot, else itself."""
    first = F.regexp_extract(url, "^([^/]*)", 1)
    return (
        F.when(url.rlike("^https?://"), F.regexp_extract(url, "^https?://([^/?#]*)", 1))
        .when(F.contains(url, F.lit("/")) & F.contains(first, F.lit(".")), first)
        .otherwise(url)
    )


def bare(domain: Column) -> Column:
    """Scheme and path cut off."""
    return F.regexp_extract(F.regexp_replace(domain, "^https?://", ""), "^([^/]*)", 1)


def is_valid_domain(domain: Column) -> Column:
    d = bare(domain)
    return F.coalesce(d.rlike(DOMAIN) & (F.length(d) <= 253), F.lit(False))


def stem(domain: Column) -> Column:
    """Domain without its last label."""
    return F.regexp_replace(domain, r"\.[^.]*$", "")


def cache_stem(domain: Column, stamp: Column) -> Column:
    return F.concat_ws("@", domain, F.substring(stamp, 1, 8))


def agent_token(agent: Column) -> Column:
    return F.lower(F.split_part(F.split_part(agent, F.lit(" "), F.lit(1)), F.lit("/"), F.lit(1)))


def playback_url(stamp: Column, url: Column) -> Column:
    """Archive playback address of a capture."""
    return F.concat(F.lit("https://web.archive.org/web/"), stamp, F.lit("if_/"), url)


def with_scheme(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def entry_ok(url: Column) -> Column:
    """Whether an address may be fetched at all: http(s), a dotted host that is
    neither internal nor an address literal."""
    host = F.lower(F.regexp_extract(url, r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    internal = F.lit(False)
    for s in K.INTERNAL_SUFFIXES:
        internal = internal | F.endswith(host, F.lit(s))
    literal = host.rlike(r"^[0-9]+(\.[0-9]+){3}$") | F.startswith(host, F.lit("["))
    return F.coalesce((host != "") & ~internal & F.contains(host, F.lit(".")) & ~literal, F.lit(False))


def is_safe_url(url: Column) -> Column:
    """No download by extension in the path, or of an address without path, and no
    suspicious pattern."""
    path = F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)", 1))
    bad = F.lit(False)
    for e in K.BLOCKED_EXTENSIONS:
        bad = bad | F.endswith(path, F.lit(e))
        if e != ".com":
            bad = bad | ((path == "") & F.endswith(F.lower(url), F.lit(e)))
    for p in K.SUSPICIOUS_URLS:
        bad = bad | url.rlike("(?i)^" + p)
    return F.coalesce(~bad, F.lit(False))


def usable_capture(status: Column, mime: Column, filename: Column, offset: Column, length: Column, url: Column, domain: Column) -> Column:
    """Index row of a home page that can be read."""
    path = F.when(F.contains(url, domain), F.substr(url, F.position(domain, url) + F.length(domain)))
    root = path.isin("", "/", "/index.html") | F.startswith(path, F.lit("/?")) | F.startswith(path, F.lit("/#"))
    given = F.lit(True)
    for c in (filename, offset, length):
        given = given & (F.coalesce(c, F.lit("")) != "")
    return F.coalesce((status == "200") & F.contains(mime, F.lit("html")) & given & root, F.lit(False))
