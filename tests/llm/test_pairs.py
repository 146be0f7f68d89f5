"""Near-duplicates, split leaks and shared spans against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from tesserine.llm import neardup, spans, splitleak
from tesserine.llm.common import words

rng = random.Random(3)
VOCAB = [f"w{i}" for i in range(300)]


def text(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(t, k):
    w = t.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(VOCAB)
    return " ".join(w)


def runs(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def texts():
    base = [text(rng.randint(45, 150)) for _ in range(25)]
    out = list(base)
    for b in base[:15]:
        out += [edited(b, k) for k in (1, 3, 6, 10)]
    out += [base[0], base[0], base[0].upper(), "", None, "few words", " ", "é " * 30, base[1] + " " + base[2], text(4000)]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "x", i, "y") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, rows[0][1], "x", 1, "y")], "fetch_id long, text string, cls string, rep int, anchor string")


def test_neardup_pairs(table):
    t = [r for r in table.collect() if r["fetch_id"] is not None and r["text"] and len(words(r["text"])) >= 40]
    s = {r["fetch_id"]: runs(r["text"], 3) for r in t}
    want = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.7}
    got = [tuple(r) for r in neardup.pairs(table).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_neardup_groups(table):
    pairs = [tuple(r) for r in neardup.pairs(table).collect()]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    g = {r["fetch_id"]: r["group_id"] for r in neardup.groups(table).collect()}
    assert all(g[i] == find(i) for i in root) and all(g[i] == i for i in g if i not in root)


def test_neardup_empty(spark):
    assert neardup.pairs(spark.createDataFrame([], "fetch_id long, text string")).count() == 0
    assert neardup.groups(spark.createDataFrame([(1, None)], "fetch_id long, text string")).count() == 0


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 40)], "id_a long, id_b long")
    assert {r["root"] for r in neardup.components(e).collect()} == {1}


def test_covering_code():
    """Every word is within RADIUS of one code word; words up to 2 * REACH apart
    share an anchor though their words differ, others need not."""
    code = [w for w in range(1 << neardup.BITS) if neardup.syndrome(w) == 0]
    assert len(code) == 1 << 11
    flips = [0, *(1 << i for i in range(neardup.BITS))]
    assert len({c ^ f for c in code for f in flips}) == len(code) * len(flips) == 1 << neardup.BITS
    r = np.random.default_rng(1)
    words_ = r.integers(0, 1 << neardup.BITS, neardup.TABLES).astype(np.uint64)
    values = r.integers(0, 1 << 60, (neardup.TABLES, neardup.PREFIX), dtype=np.uint64)
    a = neardup.anchors(values, words_)
    for d in (0, 1, 2):
        for _ in range(20):
            other = words_ ^ np.array([sum(1 << i for i in r.choice(neardup.BITS, d, replace=False)) for _ in words_], np.uint64)
            b = neardup.anchors(values, other)
            assert all(set(x) & set(y) for x, y in zip(a, b))
    assert not set(a.ravel()) & set(neardup.anchors(values + np.uint64(1), words_).ravel())


def test_near_copies_meet_their_hub_only(spark):
    base = text(120).split()
    rows = [(i, " ".join([*base, f"counter{i}"])) for i in range(80)] + [(200 + i, text(90)) for i in range(5)]
    t = spark.createDataFrame(rows, "fetch_id long, text string")
    sk = neardup.sketches(t, "fetch_id", "text")
    at = neardup.stands(sk, neardup.copies(sk))
    first = neardup.hub_candidates(at).collect()
    assert len(first) < 5 * 80
    root = neardup.components(spark.createDataFrame(first, "id_a long, id_b long"))
    assert neardup.rest_candidates(at, root).count() == 0
    g = {r["fetch_id"]: r["group_id"] for r in neardup.groups(t).collect()}
    assert all(g[i] == 0 for i in range(80)) and all(g[i] == i for i in range(200, 205))
    assert neardup.pairs(t).count() == 80 * 79 // 2


def leak_tables(spark):
    t = texts()
    doms = ["tr.example", "va.example", "te.example", "none.example"]
    rows = [(i, doms[i % 4], x, "live", "clash") for i, x in enumerate(t)]
    rows += [(900, "va.example", " ".join(t[0].split()[:45]), "live", "c"), (901, None, t[0], "live", "c"), (902, "tr.example", t[1] + " " + t[0], "archive", "c")]
    pages = spark.createDataFrame(rows, "fetch_id long, domain string, text string, source string, split string")
    v = [(" TR.example", "train"), ("va.example ", "val"), ("te.example", "test"), ("te.example", "test"), (None, "train"), ("x", None)]
    return rows, pages, spark.createDataFrame(v, "domain string, split string")


def test_leaks(spark):
    rows, pages, verdicts = leak_tables(spark)
    split = {"tr.example": "train", "va.example": "val", "te.example": "test"}
    s = {r[0]: (split.get(r[1]), runs(r[2] or "", 5), len(words(r[2] or ""))) for r in rows}
    want = set()
    for a, (sa, ra, na) in s.items():
        for b, (sb, rb, _) in s.items():
            if sa in ("val", "test") and sb == "train" and na >= 40 and len(ra & rb) >= 0.8 * len(ra):
                want.add((min(a, b), max(a, b)))
    got = [tuple(r) for r in splitleak.pairs(pages, verdicts).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (900, 902) in want
    rep = {(r["split"], r["source"]): r["pairs"] for r in splitleak.report(pages, verdicts).collect()}
    assert sum(rep.values()) == len(want)


def test_repeated_phrase_leaks(spark):
    """A phrase repeated among varying words, one word of it changed."""
    rows = []
    for i in range(60):
        phrase = [f"p{i}x{k}" for k in range(9)]
        blocks = [[f"v{i}x{b}x{k}" for k in range(3)] for b in range(5)]
        other = [w if k != i % 9 else f"q{i}" for k, w in enumerate(phrase)]
        train = " ".join(w for b in blocks for w in phrase + b)
        held = " ".join(w for n, b in enumerate(blocks) for w in (other if n == 2 else phrase) + b)
        rows += [(2 * i, "tr.example", train, "live"), (2 * i + 1, "va.example", held, "live")]
    pages = spark.createDataFrame(rows, "fetch_id long, domain string, text string, source string")
    verdicts = spark.createDataFrame([("tr.example", "train"), ("va.example", "val")], "domain string, split string")
    want = {(r[0], r[0] + 1) for r, h in zip(rows[::2], rows[1::2]) if len(runs(r[2], 5) & runs(h[2], 5)) >= 0.8 * len(runs(h[2], 5))}
    assert len(want) > 40 and {tuple(r) for r in splitleak.pairs(pages, verdicts).collect()} == want


def test_copies_are_counted_not_expanded(spark):
    a = text(60)
    rows = [(i, "tr.example" if i % 2 else "va.example", a, "live" if i < 10 else "archive") for i in range(20)]
    pages = spark.createDataFrame(rows, "fetch_id long, domain string, text string, source string")
    verdicts = spark.createDataFrame([("tr.example", "train"), ("va.example", "val")], "domain string, split string")
    got = {(r["split"], r["source"]): (r["rows"], r["pairs"], r["mean_jaccard"]) for r in splitleak.report(pages, verdicts).collect()}
    assert got == {("val", "live"): (5, 50, 1.0), ("val", "archive"): (5, 50, 1.0)}
    assert splitleak.candidates(splitleak.sketches(pages, verdicts)).count() == 1


def test_leaks_empty(spark):
    _, pages, verdicts = leak_tables(spark)
    assert splitleak.pairs(pages.limit(0), verdicts).count() == 0 and splitleak.pairs(pages, verdicts.limit(0)).count() == 0


def span_texts():
    passage = text(60) + "é — x"
    half = text(200)[:199]
    a, b, c = text(120), text(120), text(120)
    return [a + passage + b, c + passage, passage, a + half, b + half, None, "", "short", passage + " " + passage, "ab" * 300, "ab" * 250, text(3000) + passage[:210]]


def lcs(x, y):
    best, prev = 0, [0] * (len(y) + 1)
    for ch in x:
        cur = [0] * (len(y) + 1)
        for j, d in enumerate(y):
            if ch == d:
                cur[j + 1] = prev[j] + 1
                best = max(best, cur[j + 1])
        prev = cur
    return best


def test_spans(spark):
    t = span_texts()
    docs = spark.createDataFrame([(i, x, 1, "p") for i, x in enumerate(t)] + [(None, t[0], 1, "p")], "doc_id long, text string, h int, pos string")
    want = {(i, j) for i, j in itertools.combinations(range(len(t)), 2) if t[i] and t[j] and len(t[i]) < 3000 and len(t[j]) < 3000 and lcs(t[i], t[j]) >= 200}
    got = [tuple(r) for r in spans.pairs(docs).collect()]
    long = {len(t) - 1}
    assert len(got) == len(set(got)) and {p for p in got if not long & set(p)} == want and (0, 11) in got
    share = {r["doc_id"]: r for r in spans.shares(docs).where("doc_id is not null").collect()}
    assert share[2]["shared_share"] == 1.0 and share[5]["shared_chars"] == 0 and share[7]["shared_chars"] == 0
    # Every code point a shared window of the least length covers, and no other.
    for i in (0, 1, 3, 8):
        cover = set()
        for p in range(len(t[i]) - 199):
            if any(j != i and x and t[i][p : p + 200] in x for j, x in enumerate(t)):
                cover.update(range(p, p + 200))
        assert share[i]["shared_chars"] == len(cover)


def test_footer_costs_a_row_a_text(spark):
    foot = text(120)
    rows = [(i, text(80) + " " + foot) for i in range(40)] + [(100, rows_ := "ab" * 400), (101, rows_), (102, "x" + rows_)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = spans.anchors(docs)
    assert {tuple(r) for r in spans.copies(at).collect()} == {(100, 100), (101, 100)}
    assert {tuple(r) for r in spans.links(docs, at).collect()} == {(i, j) for i in range(40) for j in range(i + 1, 40)} | {(100, 102)}
    assert {(r["doc_id"], r["rep"]) for r in spans.members(docs).collect() if r["doc_id"] > 99} == {(100, 100), (101, 100), (102, 102)}


def test_spans_empty(spark):
    assert spans.pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
