"""Problem 1: the language of texts and of the parts of mixed texts.

Method.  A linear-chain conditional random field labels every word with one of
the languages of the labelled samples.  Features of a word are its lexicon entry
(itself), affixes of up to three letters, letter trigrams and its script;
numbers have none.  Transition weights are learned from sequences that join
samples of one to three languages, so the chain learns how seldom a text
switches.  Training maximises the conditional log-likelihood, its gradient by
forward-backward, full batch, over all samples; the driver holds that table and
reads it in blocks of ``CELLS`` words, and the weights are a bounded broadcast that
each worker unpacks once.  Labelling takes the marginals of forward-backward over whole texts: a word's label is the likeliest,
a part's confidence the mean marginal of its label.

A sentence of which one language holds ``SENTENCE`` is that language's.  Words
between quotation marks in another language than their line, and runs below
``RUN`` words in a line (names, titles), count for the line's language; addresses
are no words.

Defined results: rows without key are left out; NULL, empty or wordless texts have no language; ties go to the
language first in alphabetical order; repeated rows are labelled alike; an empty
table gives no rows; without samples no text has a language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .encoding import samples_of

BUCKETS = 1 << 16
STEPS = 45
RATE = 0.15
L2 = 2e-4
#: Padded words of a training block.
CELLS = 1 << 18
RUN = 5
SENTENCE = 0.7
BATCH, BATCH_WORDS = 192, 100_000
CACHE = 300_000
MIN_BODY, MIN_PART, MIN_META = 40, 20, 12

TOKEN = re.compile(r"[^\W_]+|[“”„«»\"]|[.!?…](?=[\s”»\"]|$)")
_URL = re.compile(r"https?://\S+")
_OPEN, _CLOSE = "“„«", "”»"
#: Three-letter codes of the languages and the labels that say nothing (fixed values).
CODES = {
    "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru",
}
MEANINGLESS = frozenset({"", "und", "unknown", "xx", "none", "null", "mul", "zxx", "n/a"})


def features(word: str) -> list[int]:
    if word[0].isdigit():
        return []
    w = word.lower()
    f = [f"w{w}", *(f"p{w[:i]}" for i in (1, 2, 3)), *(f"s{w[-i:]}" for i in (1, 2, 3))]
    b = f"^{w}$"
    f += [f"t{b[i : i + 3]}" for i in range(len(b) - 2)]
    f.append("c" + ("r" if "а" <= w[0] <= "ё" else "l" if w.isascii() else "x"))
    return [xxhash.xxh32_intdigest(x) % BUCKETS for x in f]


class Crf:
    """The model: langs, emission weights (BUCKETS x langs), transitions."""

    def __init__(self, langs: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.weights, self.trans = langs, weights, trans
        self.kept: dict[str, int] = {}
        self.rows = np.empty((1024, len(langs)), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Emission of every word (words x langs); distinct words are kept."""
        if len(self.kept) + len(words) > CACHE:
            self.kept.clear()
        get = self.kept.get
        at = [get(w) for w in words]
        if None in at:
            for i, k in enumerate(at):
                if k is None:
                    at[i] = self._row(words[i])
        return self.rows[at]

    def _row(self, word: str) -> int:
        k = self.kept.get(word)
        if k is None:
            k = self.kept[word] = len(self.kept)
            if k >= len(self.rows):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            f = features(word)
            e = self.weights[f].sum(0) if f else np.zeros(len(self.langs), np.float32)
            self.rows[k] = np.exp(e - e.max())
        return k

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text the marginals (words x langs) of forward-backward."""
        out: list[np.ndarray | None] = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        k = len(self.langs)
        while order:
            # Shortest first: a batch ends where its padded words would exceed BATCH_WORDS.
            n = 1
            while n < min(len(order), BATCH) and (n + 1) * len(texts[order[n]]) <= BATCH_WORDS:
                n += 1
            some, order = [i for i in order[:n] if texts[i]], order[n:]
            if not some:
                continue
            longest = len(texts[some[-1]])
            e = np.ones((longest, len(some), k), np.float32)
            for j, i in enumerate(some):
                e[: len(texts[i]), j] = self.emissions(texts[i])
            m = forward_backward(e, np.exp(self.trans).astype(np.float32), [len(texts[i]) for i in some])[0]
            for j, i in enumerate(some):
                out[i] = m[: len(texts[i]), j]
        return [x if x is not None else np.zeros((0, k), np.float32) for x in out]


def forward_backward(e: np.ndarray, a: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of emissions e (time, text, label), and expected transitions.
    Padded steps carry flat emissions and lie after a text's end; the backward
    pass starts afresh at each end."""
    t, n, k = e.shape
    al, be = np.empty_like(e), np.empty_like(e)
    al[0] = e[0] / e[0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (al[i - 1] @ a) * e[i]
        al[i] = x / x.sum(1, keepdims=True)
    ends = np.array(lengths)
    be[-1] = 1.0 / k
    at = a.T.copy()
    for i in range(t - 2, -1, -1):
        x = (be[i + 1] * e[i + 1]) @ at
        x /= x.sum(1, keepdims=True)
        if (stop := ends <= i + 1).any():
            x[stop] = 1.0 / k
        be[i] = x
    m = al * be
    m /= m.sum(2, keepdims=True)
    return m, be


def fit(samples: list[tuple[str, str]]) -> Crf:
    """Train on labelled samples, alone and joined by twos and threes."""
    langs = sorted({lang for lang, t in samples if any(w[0].isalnum() for w in TOKEN.findall(t))})
    if not langs:
        return Crf([], np.zeros((BUCKETS, 0), np.float32), np.zeros((0, 0)))
    ids = {x: i for i, x in enumerate(langs)}
    seqs = [([w for w in TOKEN.findall(t) if w[0].isalnum()], ids.get(lang)) for lang, t in samples]
    seqs = [s for s in seqs if s[0]]
    rng = np.random.default_rng(7)
    data = []
    for size in (1, 2, 3):
        order = rng.permutation(len(seqs))
        for lo in range(0, len(order), size):
            part = [seqs[i] for i in order[lo : lo + size]]
            data.append(([w for ws, _ in part for w in ws], [y for ws, y in part for _ in ws]))
    vocab: dict[str, int] = {}
    xs = [np.array([vocab.setdefault(w, len(vocab)) for w in ws]) for ws, _ in data]
    feats = [features(w) for w in vocab]
    row = np.repeat(np.arange(len(feats)), [len(f) for f in feats])
    col = np.array([c for f in feats for c in f], np.int64)
    used, col = np.unique(col, return_inverse=True)
    k = len(langs)
    blocks, gold_pairs, n = [], np.zeros((k, k)), 0.0
    for some in _blocks(list(map(len, xs))):
        lengths = [len(xs[j]) for j in some]
        shape = max(lengths), len(some)
        x, y, mask = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape, np.float32)
        for i, j in enumerate(some):
            x[: len(xs[j]), i], mask[: len(xs[j]), i], y[: len(xs[j]), i] = xs[j], 1, data[j][1]
        gold = _gold(y, mask, k)
        gold_pairs += (mask[1:, :, None, None] * gold[:-1, :, :, None] * gold[1:, :, None, :]).sum((0, 1))
        n += float(mask.sum())
        blocks.append((x, y, mask, lengths))
    w, a = np.zeros((len(used), k)), np.zeros((k, k))
    mw, vw, ma, va = np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)
    # Word rows of the feature matrix, summed by segment (every word has a feature but numbers).
    for step in range(1, STEPS + 1):
        score = np.zeros((len(feats), k))
        np.add.at(score, row, w[col])
        by_row = np.exp(score - score.max(1, keepdims=True)).astype(np.float32)
        ea = np.exp(a).astype(np.float32)
        expected, by_word = np.zeros((k, k)), np.zeros((len(feats), k))
        for x, y, mask, lengths in blocks:
            e = by_row[x]
            e[mask == 0] = 1.0
            m, be = forward_backward(e, ea, lengths)
            al = np.empty_like(e)
            al[0] = e[0] / e[0].sum(1, keepdims=True)
            for i in range(1, len(e)):
                q = (al[i - 1] @ ea) * e[i]
                al[i] = q / q.sum(1, keepdims=True)
                p = al[i - 1][:, :, None] * ea[None] * (e[i] * be[i])[:, None, :]
                p /= p.sum((1, 2), keepdims=True)
                expected += (p * mask[i][:, None, None]).sum(0)
            d = (m - _gold(y, mask, k)) * mask[:, :, None]
            np.add.at(by_word, x.ravel(), d.reshape(-1, k))
        gw = np.zeros_like(w)
        np.add.at(gw, col, by_word[row])
        gw = gw / n + L2 * w
        ga = (expected - gold_pairs) / n + L2 * a
        for p, g, m1, v1 in ((w, gw, mw, vw), (a, ga, ma, va)):
            m1 += 0.1 * (g - m1)
            v1 += 0.01 * (g * g - v1)
            p -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(v1 / (1 - 0.99**step)) + 1e-7)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[used] = w
    return Crf(langs, weights, a)


def _blocks(lengths: list[int]) -> Iterator[list[int]]:
    """Neighbouring sequences of at most CELLS padded words, at least one a block."""
    some: list[int] = []
    longest = 0
    for j, n in enumerate(lengths):
        if some and max(longest, n) * (len(some) + 1) > CELLS:
            yield some
            some, longest = [], 0
        some.append(j)
        longest = max(longest, n)
    if some:
        yield some


def _gold(y: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The right labels as indicators (time, text, label)."""
    gold = np.zeros((*y.shape, k), np.float32)
    np.put_along_axis(gold, y[:, :, None], 1, 2)
    return gold * mask[:, :, None]


def pack(model: Crf) -> tuple[tuple[str, ...], bytes, bytes, bytes]:
    """The model without its empty weight rows, to ship to the workers."""
    used = np.flatnonzero(np.abs(model.weights).sum(1) if model.langs else np.zeros(0))
    return tuple(model.langs), used.tobytes(), model.weights[used].tobytes(), model.trans.tobytes()


@lru_cache(maxsize=2)
def unpack(p: tuple[tuple[str, ...], bytes, bytes, bytes]) -> Crf:
    """The model of a worker, kept with its words from task to task."""
    langs, used, weights, trans = p
    k = len(langs)
    w = np.zeros((BUCKETS, k), np.float32)
    w[np.frombuffer(used, np.int64)] = np.frombuffer(weights, np.float32).reshape(-1, k) if k else 0
    return Crf(list(langs), w, np.frombuffer(trans).reshape(k, k))


def label_code(label: str | None) -> str | None:
    """The two-letter code a label names, None if it names none."""
    s = (label or "").strip().lower()
    if s in MEANINGLESS:
        return None
    s = re.split(r"[-_]", s)[0]
    return CODES.get(s, s if len(s) == 2 else None)


def read_words(text: str, skip: frozenset[int] | set[int] = frozenset()) -> tuple[list[str], list[int], list[bool], list[int]]:
    """(words, line, whether quoted and sentence of each) of the lines that aren't
    skipped."""
    words, lines, quoted, sentences = [], [], [], []
    sentence = 0
    for no, line in enumerate(text.split("\n")):
        if no in skip:
            continue
        sentence += 1
        inside = False
        if "://" in line:
            line = _URL.sub(" ", line)
        for t in TOKEN.findall(line):
            if t[0].isalnum():
                words.append(t)
                lines.append(no)
                quoted.append(inside)
                sentences.append(sentence)
            elif t in _OPEN:
                inside = True
            elif t in _CLOSE:
                inside = False
            elif t == '"':
                inside = not inside
            else:
                sentence += 1
    return words, lines, quoted, sentences


def _runs(x: list[int]) -> list[tuple[int, int]]:
    cuts = (np.flatnonzero(np.diff(np.array(x))) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, len(x)]))


def settle(m: np.ndarray, lines: list[int], quoted: list[bool], sentences: list[int]) -> np.ndarray:
    """Labels of the words once sentences are whole and quotations and short runs
    have joined their line."""
    lab = m.argmax(1)
    k = m.shape[1]
    if len(lab) == 0 or (lab == lab[0]).all():
        return lab
    for lo, hi in _runs(sentences):
        part = lab[lo:hi]
        if (part != part[0]).any():
            c = np.bincount(part, minlength=k)
            if c.max() >= SENTENCE * len(part):
                part[:] = c.argmax()
    page = np.bincount(lab, minlength=k).argmax()
    quote = np.array(quoted)
    for lo, hi in _runs(lines):
        part, q = lab[lo:hi], quote[lo:hi]
        if (part == part[0]).all() and not q.any():
            continue
        open_ = part[~q]
        main = np.bincount(open_, minlength=k).argmax() if len(open_) > 2 else page if q.any() else np.bincount(part, minlength=k).argmax()
        part[q] = main
        counts = np.bincount(part, minlength=k)
        most_ = counts.argmax()
        for other in np.flatnonzero((counts > 0) & (counts < RUN)):
            if other != most_:
                part[part == other] = most_
    return lab


def judge_batch(model: Crf, texts: list[tuple[str, set[int] | frozenset[int]]]) -> list[dict[str, tuple[int, float]]]:
    """Per text: language -> (words, confidence), names and quotations settled."""
    read = [read_words(t, s) for t, s in texts]
    out = []
    for (_, *where), m in zip(read, model.marginals([r[0] for r in read])):
        lab = settle(m, *where)
        got = {}
        for x in np.unique(lab):
            at = lab == x
            got[model.langs[x]] = (int(at.sum()), float(m[at, x].mean()))
        out.append(got)
    return out


def most(parts: dict[str, tuple[int, float]]) -> str | None:
    return min(parts, key=lambda x: (-parts[x][0], x)) if parts else None


def found_fields(label: str | None, body: dict, meta: dict) -> list[tuple[str, str]]:
    """The (field, lang) rows a page gives."""
    named = label_code(label)
    out = []
    n = sum(c for c, _ in body.values())
    parts = [x for x, (c, _) in body.items() if c >= MIN_PART]
    if n >= MIN_BODY and (named != most(body) or len(parts) > 1):
        out += [("text", x) for x in sorted(parts)]
    if sum(c for c, _ in meta.values()) >= MIN_META and named != most(meta):
        out.append(("meta_description", most(meta)))
    return out


def labels(table: DataFrame, samples: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, lang, words, share, confidence, label): one row per language
    of each field with words; furniture is not taken out here."""
    packed = pack(fit(samples_of(samples)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unpack(packed)
        for b in batches:
            for lo in range(0, len(b), 1000):
                part, out = b.iloc[lo : lo + 1000], []
                for f in fields:
                    if not model.langs:
                        break
                    got = judge_batch(model, [(t or "", frozenset()) for t in part[f]])
                    for i, label, g in zip(part["id"], part["label"], got):
                        n = sum(c for c, _ in g.values())
                        out += [(i, f, x, c, round(c / n, 6), round(p, 6), label_code(label)) for x, (c, p) in sorted(g.items())]
                if out:
                    yield pd.DataFrame(out, columns=["id", "field", "lang", "words", "share", "confidence", "label"])

    src = table.select(F.col(key).cast("long").alias("id"), F.col("lang").alias("label"), *fields).where("id is not null")
    schema = "id long, field string, lang string, words long, share double, confidence double, label string"
    return src.mapInPandas(run, schema).withColumnRenamed("id", key)


def segments(table: DataFrame, samples: DataFrame, key: str, field: str = "text") -> DataFrame:
    """(key, segment, lang, first_word, last_word, confidence) of maximal runs of
    one language, in texts that hold more than one."""
    packed = pack(fit(samples_of(samples)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unpack(packed)
        for b in batches:
            for lo in range(0, len(b), 1000):
                part, out = b.iloc[lo : lo + 1000], []
                read = [read_words(t or "") for t in part["text"]] if model.langs else []
                for i, (_, *where), m in zip(part["id"], read, model.marginals([r[0] for r in read])):
                    lab = settle(m, *where)
                    cuts = np.flatnonzero(np.diff(lab)) + 1
                    if len(cuts):
                        for s, (p, q) in enumerate(zip([0, *cuts], [*cuts, len(lab)])):
                            out.append((i, s, model.langs[lab[p]], int(p), int(q - 1), round(float(m[p:q, lab[p]].mean()), 6)))
                if out:
                    yield pd.DataFrame(out, columns=["id", "segment", "lang", "first_word", "last_word", "confidence"])

    src = table.select(F.col(key).cast("long").alias("id"), F.col(field).alias("text")).where("text <> '' and id is not null")
    return src.mapInPandas(run, "id long, segment long, lang string, first_word long, last_word long, confidence double").withColumnRenamed("id", key)


def found(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(fetch_id, field, lang) of unlabelled, mislabelled and mixed fields.  The
    body is what problem 2 leaves of the text; spam, residue and garbled rows are
    left out."""
    from . import residue, spam, template

    packed = pack(fit(samples_of(samples)))
    learnt = spam.learn(samples)
    page = template.parsed(pages, samples, learnt=learnt)
    line = template.judged_lines(page)
    skip = line.where("furniture").groupBy("fetch_id").agg(F.collect_set("no").alias("skip"))
    drop = residue.found(page, line, pages).union(page.where("garbled_text or garbled_html").select("fetch_id")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = unpack(packed)
        prose = spam.prose_of(learnt)  # garbled rows are gone
        for b in batches:
            for lo in range(0, len(b), 1000):
                part, out = b.iloc[lo : lo + 1000], []
                if model.langs:
                    skips = [set() if s is None else {int(x) for x in s} for s in part["skip"]]
                    body = judge_batch(model, [(t or "", s) for t, s in zip(part["text"], skips)])
                    meta = judge_batch(model, [(t or "", frozenset()) for t in part["meta_description"]])
                    for i, label, t, x, y in zip(part["fetch_id"], part["lang"], part["text"], body, meta):
                        got = found_fields(label, x, y)
                        if got and not ((j := spam.judge_right(t, prose, False)) and j[0]):
                            out += [(i, *g) for g in got]
                if out:
                    yield pd.DataFrame(out, columns=["fetch_id", "field", "lang"])

    src = pages.select(F.col("fetch_id").cast("long").alias("fetch_id"), "text", "meta_description", "lang").where("fetch_id is not null and (coalesce(text, '') <> '' or coalesce(meta_description, '') <> '')")
    src = src.join(small(drop, "8"), "fetch_id", "left_anti").join(small(skip, "24 + 4 * size(skip)"), "fetch_id", "left")
    return src.mapInPandas(run, "fetch_id long, field string, lang string").distinct()
