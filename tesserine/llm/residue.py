"""Problem 4: leftovers of a site's machinery instead of content.

Method.  Records that follow the same template are aligned, and the places where
they differ are its slots.  No list of names, defaults or messages decides.

* Placeholders.  A placeholder is an identifier between the delimiters of a
  template language.  Where it is all a title (or a part of one) or the value of a
  line 'Label: value' holds, the slot is unfilled.  Inside sentences placeholders
  are aligned by the two words on either side: a slot whose records hold different
  names is filled with values (a text about placeholders), one that holds the same
  name wherever it is seen retains its variable's name.  A name is a value if at
  least half its places are slots of the first kind; all other names are residue.
* Defaults.  Titles of the same wording are aligned: one on at least ``DOMAINS``
  domains that hardly ever shares a word with its page (``UNRELATED``), more
  often than chance allows (``CHANCE``), is a program's default.
* Filler.  Sentences without any function word of the sampled languages whose
  words stand, across the collection, in such sentences only (``OWN``): a default
  text has a vocabulary of its own.
* Messages.  Body lines are aligned by their templates: numbers and capitalised
  words are slots.  Lines of short pages are aligned again with each other word
  left out in turn, and a place that holds different words on several domains is a
  slot too.  A template on at least ``DOMAINS`` domains that takes at least
  ``TAKES`` of its pages' bodies on average is a message if most of these are too
  short to be copies of a page (``COPY`` words, as in problem 5), or if most of its
  slots vary; copies of a page repeat its values too.  A page of whose body
  messages or filler are at least ``SHARE`` is residue.

Body lines come from the template deduction of problem 2, so that furniture,
which many sites share too, isn't taken for a message.  Induction needs records to
align: a default title needs about ten, a message three.

Defined results: pages without text and without such a title are not flagged;
texts that write about such things aren't either; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, small
from .spam import TOKEN

DOMAINS = 3
SHARE = 0.3
TAKES = 0.1
COPY = 40
#: Share of a slot's records its most frequent value may have if the slot varies.
VARIES = 0.34
#: Words and signs besides its slots that a template with a left-out word keeps.
FIXED = 4
UNRELATED, CHANCE = 0.9, 1e-3
#: Words whose kind is kept per worker.
KINDS = 300_000
_kinds: dict[str, str] = {}
OWN, ORPHAN_WORDS, ORPHAN_SHARE = 0.9, 5, 0.8

_ANY = re.compile(r"[{\[$#%@_<&*]")
_NAME = r"[^\W\d_][\w.:|-]*(?: ?[\w.:|-]+){0,6}"
#: A placeholder of any name: brackets of template languages, doubled signs, spelt-out requests.
_PLACE = (
    rf"(?:[$#]?\{{\{{? ?{_NAME} ?\}}?\}}|\{{% ?{_NAME} ?%\}}|<%=? ?{_NAME} ?%>|\[\[ ?{_NAME} ?\]\]|\[[A-Z]+(?: [A-Z]+)+\]|\[[a-z]+(?:_[a-z]+)+\]"
    rf"|%%\w+%%|__[A-Z][A-Z_]*[A-Z]__|\$\$ ?\w+ ?\$\$|(?:&lt;|<)[a-z]+ here(?:&gt;|>)|@@\w+@@|\*\| ?{_NAME} ?\|\*)"
)
_INLINE = re.compile(_PLACE)
_TITLE_SLOT = re.compile(rf"(?:^|\s[|·–—-]\s)\s*{_PLACE}\s*(?:$|\s[|·–—-]\s)|^\s*(?:\[[^\[\]]+\]|\{{[^{{}}]+\}}|<[^<>]+>)\s*$")
_LINE_SLOT = re.compile(rf"(?m)^[ \t]*[^\W\d_][^\n:{{}}<>\[\]]{{0,40}}:[ \t]+{_PLACE}(?:[ \t]+{_PLACE})*[ \t]*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…][»”\"]?\s*$")


def slot_unfilled(text: str, title: str | None) -> bool:
    """Whether a part of the title, or the value of a line 'Label: value', is a
    placeholder and nothing else, whatever its syntax and name."""
    return bool(title and _ANY.search(title) and _TITLE_SLOT.search(title) or _ANY.search(text) and _LINE_SLOT.search(text))


def _kind(w: str) -> str:
    return "0" if w[0].isdigit() else "N" if w[0].isupper() else w.lower()


def page_places(text: str, title: str | None) -> tuple[list[tuple[str, int]], bool]:
    """((name, context) of the placeholders in the text, whether a slot is
    unfilled); a context is the hash of the two words on either side, or of the
    name itself where a line holds nothing else."""
    out = set()
    if text and _ANY.search(text):
        alone = [m.span() for m in _LINE_SLOT.finditer(text)]
        for m in _INLINE.finditer(text):
            lo, hi = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            left = WORD.findall(text[max(lo, m.start() - 60) : m.start()])[-2:]
            right = WORD.findall(text[m.end() : min(hi if hi >= 0 else len(text), m.end() + 60)])[:2]
            context = " ".join([*map(_kind, left), "\x01", *map(_kind, right)])
            bare = any(a <= m.start() < z for a, z in alone)
            out.update((w, xxhash.xxh64_intdigest(w if bare else context) - (1 << 63)) for w in _LETTERS.findall(m.group().lower().replace("_", " ")))
    return sorted(out), slot_unfilled(text, title)


def title_of(title: str | None, domain: str | None, words: set[str]) -> tuple[str | None, bool]:
    """(the title's words, whether none of them stands in the text or the host)."""
    ws = WORD.findall((title or "").lower())
    if not ws:
        return None, False
    host = "".join(WORD.findall((domain or "").lower()))
    return " ".join(ws), not any(w in words or w in host for w in ws)


def orphan(line: str, words: list[str], function: set[str]) -> bool:
    """Whether a line of sentences has no function word of any language."""
    return len(words) >= ORPHAN_WORDS and function.isdisjoint(words) and bool(_END.search(line))


def parts(line: str, tokens: list[str] | None = None) -> list[str]:
    """Words, numbers and signs; a line in capitals counts in small letters."""
    s = line.strip()
    if len(s) > 12 and s[1].isupper() and s[2].isupper() and 2 * sum(map(str.isupper, s)) > sum(map(str.isalpha, s)):
        return TOKEN.findall(s.lower())
    return TOKEN.findall(s) if tokens is None else tokens


def template_of(tokens: list[str]) -> tuple[list[str], list[str]]:
    """(template, values): numbers and runs of capitalised words are slots."""
    out, values, last = [], [], ""
    for w in tokens:
        c = w[0]
        k = "0" if c.isdigit() else "N" if c.isupper() else w
        if k == "N" == last:
            values[-1] += " " + w
            continue
        if k == "0" or k == "N":
            values.append(w)
        out.append(k)
        last = k
    return out, values


def _hash(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(tokens)) - (1 << 63)


def line_mask(line: str, tokens: list[str] | None = None) -> int:
    """Hash of a line's template."""
    out, get = [], _kinds.get
    for w in parts(line, tokens):
        k = get(w)
        if k is None:
            if len(_kinds) > KINDS:
                _kinds.clear()
            k = _kinds[w] = "0" if w[0].isdigit() else "N" if w[0].isupper() else w
        out.append(k)
    s = "\x1f".join(out)
    while "N\x1fN\x1f" in s:
        s = s.replace("N\x1fN\x1f", "N\x1f")
    if s.endswith("N\x1fN"):
        s = s[:-2]
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def left_out(line: str) -> list[tuple[int, str]]:
    """(hash of the line's template without one of its words, that word)."""
    tpl, _ = template_of(parts(line))
    fixed = sum(t not in ("0", "N") for t in tpl) - 1
    if fixed < FIXED:
        return []
    return [(_hash([*tpl[:j], "\x01", *tpl[j + 1 :]]), t) for j, t in enumerate(tpl) if t[0].isalpha() and t != "N"]


def unfilled(pages: DataFrame) -> DataFrame:
    """(fetch_id) of pages with a placeholder that isn't a value."""
    place = cut(pages.select("fetch_id", F.explode("places").alias("p")).select("fetch_id", "p.name", "p.context"))
    slot = place.groupBy("context").agg((F.min("name") != F.max("name")).alias("several"), F.count_distinct("fetch_id").alias("n"))
    filled = place.join(slot.where("several and n > 1").select("context").withColumn("filled", F.lit(1)), "context", "left")
    names = filled.groupBy("name").agg((2 * F.count("filled") < F.count("*")).alias("variable")).where("variable").select("name")
    return place.join(names, "name", "left_semi").select("fetch_id").union(pages.where("unfilled").select("fetch_id"))


def untitled(pages: DataFrame) -> DataFrame:
    """(fetch_id) of pages whose title is a program's default."""
    t = pages.where("title is not null").select("fetch_id", "domain", "title", F.col("unrelated").cast("int").alias("u"))
    base = t.agg(F.avg("u").alias("u")).first()["u"] or 0.0
    base = min(max(base, 0.05), 0.95)
    seen = t.groupBy("title").agg(F.avg("u").alias("share"), F.sum("u").alias("n"), F.approx_count_distinct("domain").alias("domains"))
    default = seen.where((F.col("domains") >= DOMAINS) & (F.col("share") >= UNRELATED) & (F.pow(F.lit(base), F.col("n")) <= CHANCE)).select("title")
    return t.join(default, "title", "left_semi").select("fetch_id")


def filler(pages: DataFrame, source: DataFrame) -> DataFrame:
    """(fetch_id, no) of the lines of filler text."""
    line = cut(pages.select("fetch_id", "domain", F.explode("orphans").alias("o")).select("fetch_id", "domain", "o.no", "o.words"))
    word = line.select("fetch_id", "domain", "no", F.explode("words").alias("word"))
    own = word.groupBy("word").agg(F.count("*").alias("own"), F.approx_count_distinct("domain").alias("domains")).where(F.col("domains") >= DOMAINS)
    own = small(own.select("word", "own"), "32 + length(word)")
    every = source.where("text <> ''").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))  # words beside a sign aren't counted here
    total = every.join(own.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("total"))
    vocabulary = own.join(total, "word").where(F.col("own") >= OWN * F.col("total")).select("word")
    hits = word.join(vocabulary.withColumn("known", F.lit(1)), "word", "left").groupBy("fetch_id", "no").agg(F.count("known").alias("hits"), F.count("*").alias("n"))
    return hits.where(F.col("hits") >= ORPHAN_SHARE * F.col("n")).select("fetch_id", "no")


def _lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Templates with a word left out, and slots of whole templates (at >= 0)."""
    for b in batches:
        out = []
        for i, d, text, size, nos, whole in zip(b["fetch_id"], b["domain"], b["text"], b["body"], b["nos"], b["whole"]):
            rows = text.split("\n")
            for no in nos:
                x = rows[no] if no < len(rows) else ""
                w = len(WORD.findall(x))
                if whole:
                    tpl, values = template_of(parts(x))
                    mask = _hash(tpl)
                    skip = tpl[:1] == ["N"]
                    out += [(i, d, no, mask, at, v, w / size) for at, v in enumerate(values[skip:])]
                else:
                    out += [(i, d, no, h, -1, v, w / size) for h, v in left_out(x)]
        yield pd.DataFrame(out, columns=["fetch_id", "domain", "no", "mask", "at", "value", "share"])


def messages(body: DataFrame, source: DataFrame) -> DataFrame:
    """(fetch_id, no) of body lines (fetch_id, domain, no, mask, words, body) that
    are messages."""
    line = body.where("mask is not null").withColumn("share", F.col("words") / F.col("body"))
    seen = line.groupBy("mask").agg(
        F.avg("share").alias("takes"), F.approx_count_distinct("domain").alias("domains"), F.avg((F.col("body") < COPY).cast("int")).alias("short")
    )
    seen = seen.where((F.col("domains") >= DOMAINS) & (F.col("takes") >= TAKES))
    whole = small(seen.select("mask", (F.col("short") >= 0.5).alias("short")), "16")
    at = line.join(whole, "mask", "left")
    sure = at.where("short").select("fetch_id", "no")
    ask = at.where(F.coalesce(~F.col("short"), F.col("body") < COPY)).groupBy("fetch_id", "domain", "body", F.col("short").isNotNull().alias("whole"))
    ask = small(ask.agg(F.collect_set("no").alias("nos")), "48 + length(domain) + 4 * size(nos)")
    text = source.select(F.col("fetch_id").cast("long").alias("fetch_id"), "text").where("text is not null").join(ask, "fetch_id")
    got = cut(text.mapInPandas(_lines_of, "fetch_id long, domain string, no int, mask long, at int, value string, share double"))
    value = got.groupBy("mask", "at", "value").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.approx_count_distinct("domain").alias("domains"))
    slot = value.groupBy("mask", "at").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("values"), F.sum("share").alias("share"))
    varies = F.col("most") <= VARIES * F.col("n")
    long_ = slot.where("at >= 0").groupBy("mask").agg(F.avg(varies.cast("int")).alias("v")).where("v > 0.5").select("mask", F.lit(True).alias("whole"))
    domains = got.where("at < 0").groupBy("mask").agg(F.approx_count_distinct("domain").alias("domains")).where(F.col("domains") >= DOMAINS)
    out = slot.where((F.col("at") < 0) & (F.col("values") >= DOMAINS) & (F.col("most") <= 0.5 * F.col("n")) & (F.col("share") >= TAKES * F.col("n")))
    out = out.join(domains, "mask", "left_semi").select("mask", F.lit(False).alias("whole"))
    good = long_.unionByName(out)
    more = got.withColumn("whole", F.col("at") >= 0).join(good, ["mask", "whole"], "left_semi").select("fetch_id", "no")
    return sure.unionByName(more).distinct()


def found(pages: DataFrame, lines: DataFrame, source: DataFrame) -> DataFrame:
    """(fetch_id) of the residue pages, from parsed pages, their judged lines and
    the table itself."""
    body = lines.where("not furniture and words > 0").select("fetch_id", "domain", "no", "mask", "words")
    size = body.groupBy("fetch_id").agg(F.sum("words").alias("body"))
    body = cut(body.join(size, "fetch_id"))
    said = messages(body, source).union(filler(pages, source)).distinct()
    taken = body.join(said, ["fetch_id", "no"], "left_semi").groupBy("fetch_id").agg(F.sum("words").alias("said"), F.max("body").alias("body"))
    full = taken.where(F.col("said") >= SHARE * F.col("body")).select("fetch_id")
    return unfilled(pages).union(untitled(pages)).union(full).distinct()
