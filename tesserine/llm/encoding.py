"""Problem 6: text decoded with the wrong character encoding.

Method.  For each legacy code page the characters of a text are mapped back to
the bytes they stood for.  A byte-structure automaton (compiled to one regular
expression a code page, over the page's own characters) finds the maximal spans
of those bytes that are well-formed UTF-8 multibyte sequences; only those spans
are decoded, and again while a pass still finds some, since texts are garbled
twice.  A span counts if it decodes to letters or typographic marks of the
languages at hand; one that gives Cyrillic needs two letters in a row, as
capital Cyrillic or Latin letters beside a mark can look like one.

Bytes of one single-byte page read as another have no multibyte structure.  For
those a word is re-read through each plausible pair of pages and both readings
are scored by letter-pair models of the languages, counted over all labelled
samples; a reading wins only by a clear margin.  Places whose original
characters are lost (U+FFFD, C1 controls, a lead byte without its rest) make a
field affected but not restorable there.

Every distinct word is analysed once per worker.  The letter pairs are counted
where the samples lie; only the counts are shipped (languages x letter pairs).

Defined results: rows without key are left out; NULL and empty fields are not affected; correctly decoded
unusual characters are not; an empty table gives no rows; with an empty sample
table only the automaton and the lost places count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code pages UTF-8 is misread in, most usual first.
PAGES = ("cp1252", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8_r", "cp866", "iso8859_2", "iso8859_15")
#: (read as, written in): single-byte pages taken for one another.
SWAPS = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"),
    ("cp1252", "cp1250"), ("cp1252", "iso8859_2"), ("cp1250", "cp1252"), ("iso8859_2", "cp1252"), ("cp1251", "cp1252"), ("cp1251", "cp1250"),
    ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp1252", "iso8859_5"), ("koi8_r", "cp1252"),
)
#: Nats by which a re-reading must beat the reading at hand, for a word.
MARGIN = 6.0
JOINED = 1.5
STRONG = 14.0
ROUNDS = 3
LONG = 400
CACHE = 200_000

TOKEN = re.compile("[A-Za-z\u0080-\U0010ffff]+")
#: A token that isn't all ASCII.
_ODD = re.compile("(?<![A-Za-z\u0080-\U0010ffff])[A-Za-z]*+[\u0080-\U0010ffff][A-Za-z\u0080-\U0010ffff]*+")
_HIGH = re.compile("[^\x00-\x7f]+")
_EDGE = "“”„«»‘’‚‹›–—…·•€£©®™°¿¡ "
_MARKS = set("“”„«»‘’‚‹›–—…·•€£©®™°¿¡§ªº²³´`×¼½¾ ­﻿​→←−")
#: Letters of Latin-1 and of Latin Extended-A.
_ALLOWED = {c for c in map(chr, range(0xC0, 0x180)) if c.islower()}
_ALLOWED |= {c.upper() for c in _ALLOWED if len(c.upper()) == 1} | _MARKS
#: A question mark inside a word of small letters: what a converter puts where it has no character.
_ASKED = re.compile(r"(?<![^\s“”„«»\"'(>])[^\W\d_]*[^\W\d_]\?[a-zß-öø-ÿа-яё][^\W\d_]*(?:\?[^\W\d_]+)*(?![\w=/&%?.]*[=/&%])")
_RUS = set("абвгдеёжзийклмнопрстуфхцчшщъыьэюя")
_RUS |= {c.upper() for c in _RUS}


def _to_char(page: str) -> dict[int, str]:
    """Character of each high byte; bytes a page leaves undefined stay C1."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(page)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


_CHAR = {p: _to_char(p) for p in {*PAGES, *(x for s in SWAPS for x in s), "latin_1"}}
_BYTE = {p: {c: b for b, c in m.items()} for p, m in _CHAR.items()}
for _p in ("cp1252", "iso8859_15", "iso8859_2", "cp1250"):  # C1 controls stand for their bytes in a sloppy reading
    _BYTE[_p] = {chr(b): b for b in range(0x80, 0xA0)} | _BYTE[_p]


def _automaton(page: str) -> re.Pattern:
    by = defaultdict(list)
    for c, b in _BYTE[page].items():
        by[b].append(c)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in by[b]) + "]"
    cont = cls(0x80, 0xBF)
    forms = (
        cls(0xC2, 0xDF) + cont, cls(0xE0, 0xE0) + cls(0xA0, 0xBF) + cont, cls(0xE1, 0xEC) + cont * 2, cls(0xED, 0xED) + cls(0x80, 0x9F) + cont,
        cls(0xEE, 0xEF) + cont * 2, cls(0xF0, 0xF0) + cls(0x90, 0xBF) + cont * 2, cls(0xF1, 0xF3) + cont * 3, cls(0xF4, 0xF4) + cls(0x80, 0x8F) + cont * 2,
    )
    return re.compile("(?:" + "|".join(forms) + ")+")


_AUTOMATA = {p: _automaton(p) for p in PAGES}
_LEADS = {p: frozenset(_CHAR[p][b] for b in range(0xC2, 0xF5)) for p in PAGES}


def _script(c: str) -> str:
    """Script of a letter by its Unicode name, '' for anything else."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else ""


def _plausible(decoded: str, before: str, after: str) -> bool:
    """Whether a decoded span reads as text in its place."""
    if len(decoded) == 1 and "Ā" <= decoded <= "ſ" and not (before.isalpha() or after.isalpha()):
        return False  # a lone letter among signs is a drawing
    kinds = Counter("m" if c in _MARKS else "l" if c in _ALLOWED else "r" if c in _RUS else "x" for c in decoded)
    if kinds["x"] and len(decoded) > 1 and len({_script(c) for c in decoded}) == 1 and _script(decoded[0]):
        return _script(before) != _script(decoded[0]) or not before
    if kinds["x"]:
        # A span garbled twice decodes to the lead and rest bytes of the next round.
        return any(p.search(decoded) for p in _AUTOMATA.values()) and all(ord(c) < 0x2600 for c in decoded)
    if kinds["r"]:
        alone = not before and not after and len(decoded) == 1
        return (kinds["r"] >= 2 or alone) and not (before in _RUS or after in _RUS)
    return not (before in _RUS or after in _RUS)


def decode_spans(token: str) -> tuple[str, bool]:
    """Decode the well-formed multibyte spans of a token; whether any was."""
    done = False
    for _ in range(ROUNDS):
        best = None
        for page in PAGES:
            spans, fixed, at = 0, [], 0
            for m in _AUTOMATA[page].finditer(token):
                raw = bytes(_BYTE[page][c] for c in m.group())
                try:
                    d = raw.decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if _plausible(d, token[m.start() - 1 : m.start()] if m.start() else "", token[m.end() : m.end() + 1]):
                    fixed += [token[at : m.start()], d]
                    at = m.end()
                    spans += m.end() - m.start()
            if spans and (best is None or spans > best[0]):
                best = (spans, "".join(fixed) + token[at:])
        if best is None:
            break
        token, done = best[1], True
    return token, done


#: (language, letter pair, count), sorted.
Pairs = tuple[tuple[str, str, int], ...]


def count_pairs(rows: Iterable[tuple[str, str]]) -> Pairs:
    """Letter pairs of the lower-cased words of labelled texts, by language."""
    counts: Counter = Counter()
    for lang, text in rows:
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = f"^{w}$"
            counts.update((lang, a + b) for a, b in zip(w, w[1:]))
    return tuple(sorted((*k, n) for k, n in counts.items()))


class PairModel:
    """Letter-pair models of the languages, over lower-cased words."""

    def __init__(self, pairs: Pairs):
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        first: dict[str, Counter] = defaultdict(Counter)
        for lang, pair, n in pairs:
            counts[lang][pair] = n
            first[lang][pair[0]] += n
        self.logs = {k: {p: math.log((n + 0.02) / (first[k][p[0]] + 1.2)) for p, n in c.items()} for k, c in counts.items()}
        self.first = dict(first)
        self.letters = {k: {x for p in c for x in p} for k, c in counts.items()}
        self.joined: dict[str, float] = {}
        self.alphabet = sorted(set().union(*self.letters.values()) - {"^", "$"})

    def score(self, word: str) -> float:
        """Log-likelihood under the language that reads the word best."""
        w = f"^{word.lower()}$"
        best = -1e9
        for k, logs in self.logs.items():
            f = self.first[k]
            letters = self.letters[k]
            s = 0.0
            for a, b in zip(w, w[1:]):
                p = logs.get(a + b)
                s += p if p is not None else (math.log(0.02 / (f[a] + 1.2)) if b in letters else -12.0)
            best = max(best, s)
        return best


def asked(field: str, model: PairModel) -> bool:
    """Whether question marks stand for letters: marks inside words of small
    letters, three of them, or two whose parts read better with some letter between
    them than apart, or one that reads clearly better (``JOINED`` nats)."""
    i = field.find("?")
    while i >= 0:
        if field[i - 1 : i].isalpha() and field[i + 1 : i + 2].islower():
            marked = {m.group().lower() for m in _ASKED.finditer(field)}
            if len(marked) > 2:
                return True
            gains = [_joined(w, model) for w in marked]
            return sum(g > 0 for g in gains) > 1 or any(g > JOINED for g in gains)
        i = field.find("?", i + 1)
    return False


def _joined(word: str, model: PairModel) -> float:
    """Nats a word gains by some letter in place of its marks over its parts."""
    if not model.logs:
        return math.inf
    got = model.joined.get(word)
    if got is None:
        parts = word.split("?")
        if len(model.joined) > CACHE:
            model.joined.clear()
        got = model.joined[word] = max(model.score(c.join(parts)) for c in model.alphabet) - sum(map(model.score, parts))
    return got


def reread(word: str, model: PairModel) -> tuple[str, float] | None:
    """The word as another page reads its bytes, and the gain, if clearly likelier."""
    if len(word) < 2 or not model.logs or 2 * sum(map(str.isalpha, word)) < len(word):
        return None
    if (word[1:].islower() or word.isupper()) and any(_script(c) == "CYRILLIC" and c not in _RUS for c in word) and all(_script(c) == "CYRILLIC" for c in word):
        return None  # a word of a language the samples don't hold
    here = None
    best, found = 0.0, None
    for read_as, written in SWAPS:
        to = _BYTE[read_as]
        raw = [to.get(c) if ord(c) > 127 else ord(c) for c in word]
        if None in raw:
            continue
        other = "".join(_CHAR[written][b] if b > 127 else chr(b) for b in raw)
        if other == word or not other.isalpha() or not all(ord(c) < 128 or c in _ALLOWED or c in _RUS for c in other):
            continue
        scripts = {unicodedata.name(c, "?")[:5] for c in other}
        if len(scripts) > 1:
            continue
        # A re-reading has a word's case; it doesn't turn small letters into capitals.
        if not (other.islower() or other[1:].islower() or other.isupper() and (word.isupper() or not word.isalpha())):
            continue
        if here is None:
            here = model.score(word) - (0.0 if word.islower() or word.isupper() or word[1:].islower() else 3.0)
        gain = model.score(other) - here
        if gain > best:
            best, found = gain, other
    return (found, best) if best >= MARGIN else None


class Analyser:
    """token -> (garbled, restored token, whether something is lost, sure).

    A re-reading of one word alone is not sure unless its gain is STRONG: a
    foreign name may look like one.  Two such words make a field affected."""

    def __init__(self, samples: list[tuple[str, str]] = (), pairs: Pairs | None = None):
        self.model = PairModel(count_pairs(samples) if pairs is None else pairs)
        self.kept: dict[str, tuple[bool, str, bool, bool]] = {}

    def token(self, t: str) -> tuple[bool, str, bool, bool]:
        got = self.kept.get(t)
        if got is None:
            if len(self.kept) > CACHE:
                self.kept.clear()
            got = self.kept[t] = self._token(t)
        return got

    def _token(self, t: str) -> tuple[bool, str, bool, bool]:
        if len(t) > LONG and (parts := [x for x in re.findall("[A-Za-z]+|[^A-Za-z]+", t)])[1:]:
            got = [self.token(x) for x in parts]  # no word: each run of high characters by itself
            return any(p[0] for p in got), "".join(p[1] for p in got), any(p[2] for p in got), any(p[3] for p in got)
        lost = "\ufffd" in t
        fixed, done = decode_spans(t)
        core = fixed.strip(_EDGE)
        odd = any("\x80" <= c <= "\x9f" for c in fixed) or re.search("[a-zß-ÿ][ÃÂ]$", fixed)
        other = reread(core, self.model) if not lost and not core.isascii() and len(t) <= LONG and (odd or not done) else None
        if other is not None:
            return True, fixed.replace(core, other[0]), False, bool(done or odd or other[1] >= STRONG)
        if odd:
            return True, fixed, True, True
        return done or lost, fixed, lost, done or lost

    def affected(self, field: str | None) -> bool:
        if not field:
            return False
        if asked(field, self.model):
            return True
        if field.isascii():
            return False
        weak = 0
        for t in set(_ODD.findall(field)):
            garbled, _, _, sure = self.token(t)
            if sure:
                return True
            weak += garbled
        return weak > 1

    def restore(self, field: str) -> tuple[str, bool]:
        """(restored, lossless) of an affected field."""
        lost = asked(field, self.model)

        def one(m: re.Match) -> str:
            nonlocal lost
            t = m.group()
            if t.isascii():
                return t
            garbled, fixed, gone, _ = self.token(t)
            lost |= gone
            return fixed if garbled else t

        return TOKEN.sub(one, field), not lost


@lru_cache(maxsize=2)
def analyser(pairs: Pairs) -> Analyser:
    """The analyser of a worker, kept from task to task."""
    return Analyser(pairs=pairs)


def labelled(samples: DataFrame) -> DataFrame:
    """(lang, text) of the samples that have both."""
    return samples.where("text is not null and lang is not null").select("lang", "text")


def samples_of(samples: DataFrame) -> list[tuple[str, str]]:
    """All labelled samples."""
    return sorted(map(tuple, labelled(samples).collect()))


def pairs_of(samples: DataFrame) -> Pairs:
    """The letter pairs of all labelled samples, counted by the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(list(count_pairs(zip(b["lang"], b["text"]))), columns=["lang", "pair", "n"])

    counted = labelled(samples).mapInPandas(run, "lang string, pair string, n long").groupBy("lang", "pair").agg(F.sum("n"))
    return tuple(sorted(map(tuple, counted.collect())))


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, field) of the affected fields."""
    pairs = pairs_of(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        an = analyser(pairs)
        for b in batches:
            out = [(i, f) for f in ("text", "html") for i, x in zip(b["fetch_id"], b[f]) if an.affected(x)]
            if out:
                yield pd.DataFrame(out, columns=["fetch_id", "field"])

    src = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), "text", "html").where("fetch_id is not null")
    return src.mapInPandas(run, "fetch_id long, field string").distinct()


def restored(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, field, restored, lossless) of the affected fields."""
    pairs = pairs_of(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        an = analyser(pairs)
        for b in batches:
            out = []
            for f in ("text", "html"):
                for i, x in zip(b["fetch_id"], b[f]):
                    if an.affected(x):
                        out.append((i, f, *an.restore(x)))
            if out:
                yield pd.DataFrame(out, columns=["fetch_id", "field", "restored", "lossless"])

    src = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), "text", "html").where("fetch_id is not null")
    return src.mapInPandas(run, "fetch_id long, field string, restored string, lossless boolean")
