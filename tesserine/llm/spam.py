"""Problem 3: pages of stuffed keywords, link lists and product tags.

Method.  A text becomes a sequence of classes: function words stand for
themselves, other words for their class (capital or small initial; seen once or
at least twice in the last ``REACH`` tokens), numbers, addresses, list marks, line
ends and sentence marks for theirs.  An interpolated trigram model of such
sequences is trained on prose (all labelled language samples); function words are
each language's ``FUNCTION_WORDS`` most widespread words there.  Words and trigrams
are counted where the samples lie; the driver gets those few words and at most as
many trigrams as there are triples of classes.
A page's text is read in windows of ``WINDOW`` tokens; a token's surprise is the
mean over the window around it, and a page's that of its median token, so a
sentence in front does not save a page, nor a list inside an article condemn it.
What is abnormal is learnt from held-out prose: each half of the samples is scored
by the model of the other, joined by threes, and a page whose surprise lies more
than ``SPREAD`` standard deviations above their mean isn't prose, nor one as far
below that also repeats itself.  The bound widens as the length shrinks for
pages less than half as long as the held-out ones.

Garbled text is restored before it is scored, a text in capitals is read in
small letters, and places for values count as words; pages of which these are more
than an eighth are problem 4's.

Defined results: rows without key are left out; NULL, empty and texts shorter than a window (``WINDOW`` tokens) are not
spam; texts whose letters are lost are not judged; extra columns are ignored; an
empty table gives no rows; an empty sample table flags nothing.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .encoding import Analyser, analyser, labelled, pairs_of

FUNCTION_WORDS = 20
REACH = 24
WINDOW = 24
SPREAD = 5.4
LOST = 0.02
CACHE = 400_000

TOKEN = re.compile(r"https?://\S+|[^\W\d_]+(?:['’-][^\W\d_]+)*|\d[\d.,:]*|\n|[^\w\s]|_")
#: Usual syntaxes of a place for a value.
PLACE = re.compile(
    r"(?=[{\[$#%@_<&])(?:\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|<%[^%\n]{1,60}%>|\[\[[^\]\n]{1,60}\]\]|\[[A-Z]+(?: [A-Z]+)+\]|\[[a-z]+(?:_[a-z]+)+\]"
    r"|%%\w{1,60}%%|__[A-Z][A-Z_]{0,60}__|\$\$ ?\w{1,60} ?\$\$|\{[a-z]+:[a-z]+\}|&lt;[^&\n]{1,60}&gt;|<[a-z]+ here>|@@\w{1,60}@@)"
)
_CAPITAL = re.compile("[A-ZÀ-ÖØ-ÞĄĆĘŁŃÓŚŹŻА-ЯЁ]")
_SENTENCE = set(",.;:!?()“”\"'«»–—-…")
_LISTING = set("|·•/>»")


#: A model's function words, the keys and counts of its trigrams (as bytes) and its bounds.
Learnt = tuple[tuple[str, ...], bytes, bytes, tuple[float, float, float]]


def spread_of(rows: Iterable[tuple[str, str]]) -> dict[str, Counter]:
    """Per language the number of texts each word stands in."""
    spread: dict[str, Counter] = defaultdict(Counter)
    for lang, text in rows:
        spread[lang].update(set(re.findall(r"[^\W\d_]+", text.lower())))
    return spread


class ProseModel:
    """Class trigrams of prose, smoothed by interpolation."""

    def __init__(self, samples: list[tuple[str, str]] = (), function: Iterable[str] | None = None, trigrams: dict[int, int] | None = None):
        if function is None:
            function = [w for c in spread_of(samples).values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:FUNCTION_WORDS] if n > 3]
        self.function = set(function)
        names = ["w", "C", "r", "R", "0", "U", "\n", "|", "#", *sorted(_SENTENCE), *sorted(self.function)]
        self.id = {n: i for i, n in enumerate(names)}
        self.n = len(names) + 1  # the last stands for the beginning
        self.kept: dict[str, int] = {}
        self.word: dict[str, int] = {}
        self.bounds = (0.0, np.inf, 1.0)
        tri = self.trigrams(t for _, t in samples) if trigrams is None else trigrams
        self.fit(np.array(sorted(tri), np.int64), np.array([tri[k] for k in sorted(tri)], float))

    def trigrams(self, texts: Iterable[str]) -> Counter:
        """The class trigrams of texts, counted."""
        n, tri = self.n, Counter()
        for t in texts:
            q = [n - 1, n - 1, *self.sequence(t).tolist(), self.id["\n"]]
            tri.update((a * n + b) * n + c for a, b, c in zip(q, q[1:], q[2:]))
        return tri

    def fit(self, keys: np.ndarray, counts: np.ndarray) -> None:
        n = self.n
        self.keys, self.counts = keys, counts
        uni, bi = np.zeros(n), np.zeros((n, n))
        np.add.at(uni, keys % n, counts)
        np.add.at(bi, (keys // n % n, keys % n), counts)
        one = (uni + 0.1) / (uni.sum() + 0.1 * n)
        self.two = (bi + 2 * one) / (bi.sum(1, keepdims=True) + 2)
        self.context = np.zeros(n * n)
        np.add.at(self.context, keys // n, counts)

    def _class(self, t: str) -> int:
        c = t[0]
        if t == "\n":
            name = t
        elif c.isdigit():
            name = "0"
        elif t.startswith(("http://", "https://")):
            name = "U"
        elif c.isalpha():
            low = t.lower()
            name = low if low in self.function else "C" if c.isupper() else "w"
        else:
            name = t if t in _SENTENCE else "|" if t in _LISTING else "#"
        return self.id[name]

    def sequence(self, text: str, tokens: list[str] | None = None) -> np.ndarray:
        """Classes of the tokens; content words are kept as negative numbers of
        their word and case, so that their repeats are found at once."""
        if len(self.kept) > CACHE:
            self.kept.clear()
            self.word.clear()
        tokens, get = TOKEN.findall(text) if tokens is None else tokens, self.kept.get
        out = [get(t) for t in tokens]
        if None in out:
            for i, v in enumerate(out):
                if v is None:
                    v = self._class(t := tokens[i])
                    out[i] = self.kept[t] = -1 - (2 * self.word.setdefault(t.lower(), len(self.word)) + v) if v < 2 else v
        q = np.array(out, np.int64)
        at = np.flatnonzero(q < 0)
        code = -1 - q[at]
        q[at] = code & 1
        order = np.argsort(code >> 1, kind="stable")
        word, at = (code >> 1)[order], at[order]
        for back, name in ((1, 2), (2, 3)):
            near = (word[back:] == word[:-back]) & (at[back:] - at[:-back] <= REACH)
            q[at[back:][near]] = name
        return q

    def surprise(self, q: np.ndarray) -> np.ndarray:
        n, start = self.n, self.n - 1
        x = np.concatenate([[start, start], q])
        a, b, c = x[:-2], x[1:-1], x[2:]
        key = (a * n + b) * n + c
        at = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
        seen = np.where(self.keys[at] == key, self.counts[at], 0.0)
        return -np.log((seen + 2 * self.two[b, c]) / (self.context[a * n + b] + 2))

    def page(self, text: str, tokens: list[str] | None = None) -> tuple[float, int, float]:
        """(median surprise of the page's windows, tokens, share of repeats)."""
        if len(_CAPITAL.findall(text)) > 0.35 * len(text) and sum(map(str.isupper, text)) > 0.5 * sum(map(str.isalpha, text)):
            text, tokens = text.lower(), None
        q = self.sequence(text, tokens)
        if len(q) < WINDOW:
            return 0.0, len(q), 0.0
        s = np.concatenate([[0.0], np.cumsum(self.surprise(q))])
        mean = (s[WINDOW:] - s[:-WINDOW]) / WINDOW
        at = (np.arange(len(q)) - WINDOW // 2).clip(0, len(mean) - 1)
        return float(np.median(mean[at])), len(q), float(((q == 2) | (q == 3)).mean())


@lru_cache(maxsize=2)
def model_of(samples: tuple[tuple[str, str], ...]) -> ProseModel:
    """The model of all samples with the bounds of held-out prose: (mean,
    standard deviation, tokens)."""
    seen = []
    for k in (0, 1):
        half = ProseModel(list(samples[k::2]))
        by: dict[str, list[str]] = defaultdict(list)
        for lang, text in samples[1 - k :: 2]:
            by[lang].append(text)
        for texts in by.values():
            seen += [half.page("\n".join(texts[i : i + 3]))[:2] for i in range(0, len(texts), 3)]
    seen = [(s, n) for s, n in seen if n >= WINDOW]
    model = ProseModel(list(samples))
    if len(seen) > 2:
        s = np.array(seen)
        model.bounds = float(s[:, 0].mean()), float(s[:, 0].std()), float(s[:, 1].mean())
    return model


def numbered(samples: DataFrame) -> DataFrame:
    """(lang, text, at, half) of all different labelled samples (copies would leave no
    half held out): the place in the language, and
    the half that holds every other one of all, by language and text."""
    rows = labelled(samples).distinct()
    size = rows.groupBy("lang").agg(F.count("*").alias("size"))
    before = size.select("lang", (F.sum("size").over(Window.orderBy("lang")) - F.col("size")).alias("before"))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("text")) - 1).join(before, "lang")
    return cut(rows.select("lang", "text", "at", ((F.col("before") + F.col("at")) % 2).cast("int").alias("half")))


def function_words(rows: DataFrame) -> list[set[str]]:
    """The function words of the first half, of the second and of all samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(h, lang, w, n) for h, part in b.groupby("half") for lang, c in spread_of(zip(part["lang"], part["text"])).items() for w, n in c.items()]
            yield pd.DataFrame(out, columns=["half", "lang", "word", "n"])

    half = lambda h: F.sum(F.when(F.col("half") == h, F.col("n")).otherwise(0))
    word = rows.select("half", "lang", "text").mapInPandas(run, "half int, lang string, word string, n long")
    word = word.groupBy("lang", "word").agg(F.array(half(0), half(1), F.sum("n")).alias("n")).select("lang", "word", F.posexplode("n").alias("model", "n")).where("n > 3")
    top = word.withColumn("r", F.row_number().over(Window.partitionBy("model", "lang").orderBy(F.desc("n"), "word"))).where(F.col("r") <= FUNCTION_WORDS)
    out: list[set[str]] = [set(), set(), set()]
    for r in top.select("model", "word").collect():
        out[r["model"]].add(r["word"])
    return out


def learn(samples: DataFrame) -> Learnt:
    """The model of all samples with the bounds of held-out prose; see ``model_of``."""
    rows = numbered(samples)
    words = function_words(rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = [ProseModel(function=w, trigrams={}) for w in words]
        for b in batches:
            out = [(m, k, n) for m, part in (*b.groupby("half"), (2, b)) for k, n in models[m].trigrams(part["text"]).items()]
            yield pd.DataFrame(out, columns=["model", "key", "n"])

    tri: list[dict[int, int]] = [{}, {}, {}]
    for m, k, n in rows.select("half", "text").mapInPandas(count, "model int, key long, n long").groupBy("model", "key").agg(F.sum("n")).collect():
        tri[m][k] = n
    halves = [ProseModel(function=w, trigrams=t) for w, t in zip(words[:2], tri)]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [halves[1 - h].page(t)[:2] for h, t in zip(b["half"], b["text"]) if len(halves[1 - h].keys)]
            yield pd.DataFrame(out, columns=["s", "n"])

    joined = F.array_join(F.expr("transform(array_sort(collect_list(struct(at, text))), x -> x.text)"), "\n").alias("text")
    held = rows.groupBy("lang", "half", F.floor(F.col("at") / 6).alias("part")).agg(joined).select("half", "text").mapInPandas(score, "s double, n long")
    got = held.where(F.col("n") >= WINDOW).agg(F.count("*"), F.avg("s"), F.stddev_pop("s"), F.avg("n")).first()
    keys = sorted(tri[2])
    bounds = tuple(got[1:]) if got[0] > 2 else (0.0, np.inf, 1.0)
    return tuple(sorted(words[2])), np.array(keys, np.int64).tobytes(), np.array([tri[2][k] for k in keys], float).tobytes(), bounds


@lru_cache(maxsize=2)
def prose_of(learnt: Learnt) -> ProseModel:
    """The model of a worker, kept from task to task."""
    function, keys, counts, bounds = learnt
    model = ProseModel(function=function, trigrams={})
    model.fit(np.frombuffer(keys, np.int64), np.frombuffer(counts, float))
    model.bounds = bounds
    return model


def judge(text: str | None, prose: ProseModel, an: Analyser) -> tuple[bool, float] | None:
    """(spam, median surprise) of a text that can be judged."""
    garbled = an.affected(text)
    return judge_right(an.restore(text)[0] if garbled else text, prose, garbled)


def judge_right(text: str | None, prose: ProseModel, garbled: bool, tokens: list[str] | None = None) -> tuple[bool, float] | None:
    """The same for a text whose encoding has been repaired and, it may be, whose
    tokens are at hand."""
    if not text or len(prose.keys) == 0 or garbled and text.count("�") > LOST * len(text):
        return None
    text, places = PLACE.subn(" x ", text)
    m, n, repeats = prose.page(text, None if places else tokens)
    if n < WINDOW or places * 8 > n:
        return None
    mean, sd, tokens = prose.bounds
    wide = SPREAD * sd * max(1.0, tokens / 2 / n)
    return m > mean + wide or (m < mean - wide and repeats > 0.5), m


def scored(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, domain, surprise, spam) of the pages that can be judged."""
    learnt, pairs = learn(samples), pairs_of(samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose, an = prose_of(learnt), analyser(pairs)
        for b in batches:
            out = []
            for i, d, t in zip(b["fetch_id"], b["domain"], b["text"]):
                got = judge(t, prose, an)
                if got:
                    out.append((i, d, got[1], got[0]))
            if out:
                yield pd.DataFrame(out, columns=["fetch_id", "domain", "surprise", "spam"])

    src = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), "domain", "text").where("text <> '' and fetch_id is not null")
    return src.mapInPandas(run, "fetch_id long, domain string, surprise double, spam boolean")


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    return scored(pages, samples).where("spam").select("fetch_id").distinct()


def by_category(pages: DataFrame, verdicts: DataFrame, samples: DataFrame) -> DataFrame:
    """Pages judged and spam pages per old category of the domain's verdicts; a
    domain with several categories counts under the least, one without under ''."""
    d = F.lower(F.regexp_replace("domain", r"(?U)^\s+|\s+$", ""))
    cat = verdicts.where("old_category is not null").groupBy(d.alias("domain")).agg(F.min("old_category").alias("old_category"))
    return (
        scored(pages, samples)
        .join(cat, "domain", "left")
        .groupBy(F.coalesce("old_category", F.lit("")).alias("old_category"))
        .agg(F.count("*").alias("pages"), F.count_if("spam").alias("spam_pages"), F.round(F.avg("surprise"), 4).alias("mean_surprise"))
    )
