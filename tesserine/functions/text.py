"""Text cleaning and measuring as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

#: Unicode white space, spelled out so that it means the same in every dialect.
WS = r"[\t\n\x0B\f\r \x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: ASCII punctuation and the bars, dashes and dots of page furniture.
PUNCT = r"[!-/:-@\[-`{-~|–—•·…]"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def clean(text: Column) -> Column:
    """White space collapsed, ends cut, small letters."""
    return F.lower(collapse(text))


def clean_words(text: Column) -> Column:
    """Like ``clean``, without the tokens that are only punctuation."""
    return F.array_join(F.filter(F.split(clean(text), " "), lambda w: (w != "") & ~w.rlike(f"^{PUNCT}+$")), " ")


def clean_set(text: Column) -> Column:
    """Distinct ASCII words in code point order: digits dropped, punctuation cut
    from the ends, longer than one letter, common words left out."""
    words = F.transform(F.split(collapse(F.regexp_replace(text, r"\p{Nd}", "")), " "), lambda w: F.regexp_replace(F.regexp_replace(w, r"^[!-/:-@\[-`{-~]+", ""), r"[!-/:-@\[-`{-~]+$", ""))
    kept = F.filter(F.transform(words, F.lower), lambda w: w.rlike("^[a-z]{2,}$") & ~w.isin(*K.COMMON_WORDS))
    return F.array_join(F.array_sort(F.array_distinct(kept)), " ")


def tokens(text: Column) -> Column:
    """Number of white-space separated tokens."""
    return F.coalesce(F.size(F.filter(F.split(text, WS + "+"), lambda w: w != "")), F.lit(0))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("... [truncated]"))).otherwise(text)


def excerpt(text: Column, n: int) -> Column:
    return F.left(collapse(text), F.lit(n))


def html_title(html: Column) -> Column:
    raw = F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(raw, f"^{WS}+", ""), f"{WS}+$", ""))


def description_patterns(attribute: str, name: str) -> list[str]:
    """Patterns of a meta tag's content, its attributes in either order and in
    either kind of quotation marks."""
    named = f"{attribute}\\s*=\\s*[\"']{name}[\"']"
    return [f"(?is)<meta\\s{x}>" for q in "\"'" for x in (f"[^>]*{named}[^>]*\\scontent\\s*=\\s*{q}([^{q}]*){q}[^>]*", f"(?:[^>]*\\s)?content\\s*=\\s*{q}([^{q}]*){q}[^>]*{named}[^>]*")]


DESCRIPTIONS = (*description_patterns("name", "description"), *description_patterns("property", "og:description"))


def html_description(html: Column) -> Column:
    """Content of the description tag, else of its social twin."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in DESCRIPTIONS])


def visible(html: Column) -> Column:
    """Visible text by removal of scripts, styles, title, comments and tags."""
    x = html
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<title[^>]*>.*?</title>", "(?s)<!--.*?-->", "(?i)<!doctype[^>]*>", "(?s)<[^>]*>"):
        x = F.regexp_replace(x, p, " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return collapse(x)
