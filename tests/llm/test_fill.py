"""Containers and mixes: capacities, caps, balance, hand-made cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserine.llm import mixing, packing, tokens


def boxes(hist, capacity):
    rows, n = packing.plan(hist, capacity)
    fixed, left = packing.reduce(hist, capacity)
    groups = fixed + packing.best_fit(left, capacity)
    got = Counter()
    for times, items in groups:
        assert sum(items) <= capacity
        for s in items:
            got[s] += times
    assert got == Counter({s: c for s, c in hist.items() if c}) and sum(t for t, _ in groups) == n
    return n


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=12))
def test_plans_hold_everything(hist):
    n = boxes(hist, 30)
    assert n >= -(-sum(s * c for s, c in hist.items()) // 30)


def optimal(sizes, capacity):
    best = len(sizes)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        bins.append(sizes[i])
        go(i + 1, bins)
        bins.pop()

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_an_optimum(seed):
    """Fixed sets dominate: with them the rest still reaches the optimum."""
    r = random.Random(seed)
    cap = 20
    sizes = sorted((r.randint(2, 19) for _ in range(9)), reverse=True)
    fixed, left = packing.reduce(dict(Counter(sizes)), cap)
    rest = sorted((s for s, c in left.items() for _ in range(c)), reverse=True)
    assert sum(t for t, _ in fixed) + optimal(rest, cap) == optimal(sizes, cap)


def docs(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "gamma"]) for _ in range(r.choice([1, 5, 40, 300]))), "s1" if i % 3 else "s2", "clash") for i in range(120)]
    rows += [(200, "", "s1", "c"), (201, None, "s1", "c"), (202, " \n", "s1", "c"), (203, "alpha", None, "c"), (None, "alpha", "s1", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n string")


def test_containers(spark):
    c = tokens.token_counts(docs(spark))
    size = {r["doc_id"]: r["n"] for r in c.collect()}
    assert 200 not in size and 201 not in size and 202 not in size and len(size) == 121
    specs = spark.createDataFrame([("a", 64, 0, "x"), ("b", 100, 2, "x"), ("b", 100, 2, "x"), ("bad", 0, 0, "x"), ("nul", None, None, "x")], "spec_id string, capacity_tokens long, gap_tokens long, cap string")
    got = packing.assign(c, specs).collect()
    for spec, cap, gap in (("a", 64, 0), ("b", 100, 2)):
        own = [r for r in got if r["spec_id"] == spec]
        assert Counter((r["doc_id"]) for r in own) == Counter({d: -(-n // cap) for d, n in size.items()})
        held, per = Counter(), Counter()
        for r in own:
            held[r["container_id"]] += r["tokens"]
            per[r["container_id"]] += 1
        assert all(held[k] + (per[k] - 1) * gap <= cap for k in held) and set(held) == set(range(len(held)))
        total = Counter()
        for r in own:
            total[r["doc_id"]] += r["tokens"]
        assert total == Counter(size)
    assert {r["spec_id"] for r in got} == {"a", "b"}
    s = {r["spec_id"]: r for r in packing.summary(packing.assign(c, specs), specs).collect()}
    assert s["a"]["least_containers"] <= s["a"]["containers"]
    assert packing.assign(c, specs.limit(0)).count() == 0 and packing.assign(c.limit(0), specs).count() == 0


def test_flight_keeps_totals():
    r = np.random.default_rng(0)
    x, pi = r.integers(1, 900, 600).astype(float), np.full(600, 0.3)
    p = mixing.flight(pi, x, r)
    assert ((p > 0) & (p < 1)).sum() <= 2 and p.sum() == pytest.approx(180) and (p * x).sum() == pytest.approx((pi * x).sum())
    q = mixing.land(p, x)
    assert set(q) <= {0.0, 1.0} and abs((q * x).sum() - (pi * x).sum()) <= 2


def test_flight_is_fair():
    """Each document keeps its inclusion probability."""
    x = np.array([5, 1, 9, 4, 4, 7, 2, 8], float)
    hits = sum(mixing.flight(np.full(8, 0.25), x, np.random.default_rng(s)) for s in range(3000)) / 3000
    assert abs(hits - 0.25).max() < 0.04


def test_allot():
    assert mixing.allot({"a": 1, "b": 1}, {"a": 100, "b": 10}, {"a": 1, "b": 2}, 80) == {"a": 60.0, "b": 20.0}
    assert mixing.allot({"a": 1, "ghost": 1}, {"a": 10}, {"a": 2, "ghost": 9}, 100) == {"a": 20.0}
    assert mixing.allot({}, {}, {}, 5) == {}


def test_mix(spark):
    c = tokens.token_counts(docs(spark))
    m = spark.createDataFrame(
        [("m", "s1", 0.6, 1, 0.5, "x"), ("m", "s2", 0.3, 3, 0.5, "x"), ("m", "ghost", 0.1, 3, 0.5, "x"), ("n", "s2", 1.0, 2, 3.0, "x"), ("z", "s1", None, None, None, "x"), (None, "s1", 1.0, 1, 1.0, "x")],
        "mix_id string, source string, target_share double, max_repeats long, budget_share double, n string",
    )
    got = mixing.mix(c, m).collect()
    assert len({(r["mix_id"], r["doc_id"]) for r in got}) == len(got)
    caps = {("m", "s1"): 1, ("m", "s2"): 3, ("n", "s2"): 2}
    assert all(1 <= r["repeats"] <= caps[r["mix_id"], r["source"]] for r in got)
    s = {(r["mix_id"], r["source"]): r for r in mixing.shares(c, m).collect()}
    assert abs(s["m", "s1"]["actual_share"] - 2 / 3) < 0.03 and s["m", "ghost"]["tokens"] == 0 and s["n", "s2"]["capped"]
    assert s["n", "s2"]["most_repeats"] == 2 and s["z", "s1"]["tokens"] == 0
    assert sorted(tuple(r) for r in mixing.mix(c, m).collect()) == sorted(tuple(r) for r in got)
    assert mixing.mix(c.limit(0), m).count() == 0


def test_mix_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    c = spark.range(1000).selectExpr("id as doc_id", "'s' as source", "(id * 37) % 101 + 1 as n")
    m = spark.createDataFrame([("m", "s", 1.0, 1, 0.4)], "mix_id string, source string, target_share double, max_repeats long, budget_share double")
    r = mixing.shares(c, m).first()
    assert abs(r["tokens"] - r["allotted_tokens"]) < 60
