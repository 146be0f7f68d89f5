"""Published edge cases of the scalar operators."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserine.functions import maths, outcomes, rules, taxonomy, text, url
from tesserine.operators import addresses, metrics, ranking, replies, reports
from tesserine.plans import catalogue


def one(spark, expr, **cols):
    names = list(cols)
    kind = {str: "string", int: "long", float: "double", bool: "boolean", type(None): "string"}
    schema = ", ".join(f"{n} {'array<double>' if isinstance(v, list) else kind[type(v)]}" for n, v in cols.items())
    return spark.createDataFrame([tuple(cols[n] for n in names)], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "u, want",
    [("https://example.com:8080/path", "example.com:8080"), ("https://", ""), (None, None), ("sub.example.com/path", "sub.example.com"), ("example.com", "example.com"), ("HTTPS://x.example/", "HTTPS:" if False else "HTTPS://x.example/")],
)
def test_domain_of(spark, u, want):
    assert one(spark, url.domain_of(F.col("u")), u=u) == want


@pytest.mark.parametrize("d, ok", [("example.com", True), ("a-b.example", True), ("-a.example", False), ("a..b", False), ("nodots", False), ("host.example:80", False), ("x_y.example", False), (None, False), ("a" * 64 + ".example", False)])
def test_domain_valid(spark, d, ok):
    assert one(spark, url.is_valid_domain(F.col("d")), d=d) is ok


@pytest.mark.parametrize("raw, want", [("sex/education", "education"), ("sex/lingerie", "adult"), ("finance/banking", "finance"), ("finance/realestate", "realestate"), ("recreation/sports", "sports"), ("spyware", None), ("hobby", None), ("hobby/games-online", "games"), ("webradio", "radiotv"), ("aggressive", None)])
def test_taxonomy(spark, raw, want):
    assert one(spark, taxonomy.map_category(F.col("r")), r=raw) == want


def test_projection_conserves_mass(spark):
    names, groups = taxonomy.project_labels(["porn", "sex", "news", "adv", "hobby/gardening"])
    assert names == ["adult", "news", "gardening"]
    p = one(spark, maths.grouped(F.col("p"), groups), p=[0.2, 0.1, 0.3, 0.2, 0.2])
    assert p == pytest.approx([0.375, 0.375, 0.25]) and sum(p) == pytest.approx(1)


def test_fusion(spark):
    assert one(spark, maths.fused(F.col("a"), F.col("b"), 0.5), a=[0.6, 0.4], b=[0.2, 0.8]) == pytest.approx([0.4, 0.6])
    assert one(spark, maths.fused(F.col("a"), F.col("b"), [1.0, 0.5]), a=[0.5, 0.5], b=[0.5, 0.5]) == pytest.approx([0.5, 0.5])


def test_argmax_takes_the_first(spark):
    assert one(spark, maths.argmax(F.col("a")), a=[0.2, 0.4, 0.4]) == 2


@settings(max_examples=20, deadline=None)
@given(st.text("abcXYZ. -ü ", min_size=1, max_size=12))
def test_split_matches_hashlib(spark, d):
    h = int(hashlib.sha256(d.strip(" ").lower().encode()).hexdigest()[:8], 16) % 100
    want = "train" if h < 80 else "val" if h < 90 else "test"
    assert one(spark, maths.hash_split(F.col("d")), d=d) == want


@settings(max_examples=20, deadline=None)
@given(st.text(" \t\n  ab", max_size=20))
def test_tokens_match_split(spark, t):
    assert one(spark, text.tokens(F.col("t")), t=t) == len(t.split())


@pytest.mark.parametrize(
    "page, blocked, vendor",
    [
        ("<html>window._cf_chl_opt={}</html>", True, "cloudflare"),
        ("<title>Just a moment...</title>", True, "challenge_title"),
        ('<div class="g-recaptcha"></div>' + "x" * 70_000, False, None),
        ('<div class="g-recaptcha"></div> you don\'t have permission to access', True, "recaptcha"),
        ("<title>d.example</title>", True, "stub"),
        ("access denied", True, "access_denied"),
        ("", False, None),
        ("<p>hello</p>", False, None),
    ],
)
def test_block(spark, page, blocked, vendor):
    r = one(spark, rules.block(F.col("h"), F.col("d")), h=page, d="d.example")
    assert (r["blocked"], r["vendor"]) == (blocked, vendor)


def test_parked_and_unavailable(spark):
    p = lambda t: one(spark, rules.parked(F.col("t")), t=t)
    u = lambda t: one(spark, rules.unavailable(F.col("t")), t=t)
    assert p("This domain is for sale") and p("word " * 400 + "sedo.com") and not p("word " * 260 + "is for sale") and not p(None)
    assert u("Coming soon") and not u("word " * 70 + "coming soon") and u("Index of /")


@pytest.mark.parametrize(
    "m, code",
    [("Timeout 30000ms", "timeout"), ("Name or service not known", "dns_error"), ("robots.txt", "robots_blocked"), ("HTTP 429", "archive_rate_limited"), ("no memento", "no_archive_snapshot"), ("Connection reset", "connection_error"), ("bad HTTP status", "http_error"), ("?", "unknown")],
)
def test_error_code(spark, m, code):
    assert one(spark, outcomes.error_code(F.col("m")), m=m) == code


def test_annotate_is_idempotent(spark):
    x = spark.createDataFrame([(1, "news", "", None, None, None), (2, None, "boom", None, None, "timeout"), (3, "news", "boom", "", "", "")], "fetch_id long, category string, error string, status string, stage string, error_code string")
    a = reports.annotate(x)
    assert a.collect() == reports.annotate(a).collect()
    assert [(r["status"], r["error_code"], r["retryable"]) for r in a.orderBy("fetch_id").collect()] == [("ok", None, False), ("failed", "timeout", True), ("failed", "unknown", False)]


@pytest.mark.parametrize("a, ok", [("8.8.8.8", True), ("10.0.0.1", False), ("::ffff:10.0.0.1", False), ("224.0.0.1", False), ("garbage", False), ("", False)])
def test_addresses(a, ok):
    assert addresses.public(a) is ok


def test_wilson_and_mcnemar(spark):
    lo, hi = maths.wilson(F.col("h"), F.col("n"))
    assert one(spark, lo, h=8, n=10) == pytest.approx(0.4901625, abs=1e-5) and one(spark, hi, h=8, n=10) == pytest.approx(0.9433178, abs=1e-5)
    assert metrics.mcnemar_p(0, 0) == 1.0 and metrics.mcnemar_p(10, 0) == pytest.approx(2 / 1024)


def test_replies():
    ok = '{"domain": "A.example ", "category": "News", "confidence": 1.7}'
    assert replies.parse(ok) == [("a.example", "news", 1.0, "No reasoning provided")]
    assert len(replies.parse(f"```json\n[{ok}, {ok}]\n```")) == 2
    assert replies.parse("{category: \"sports\"}") == [(None, "sports", 0.5, "No reasoning provided")]
    assert replies.parse("Category: finance, confidence: 0.8")[0][1:3] == ("finance", 0.8)
    assert replies.parse("[]") == [] and replies.parse(None) == [] and replies.parse("gibberish") == []


def test_running_counts(spark):
    n = 3 * ranking.BLOCK // 2
    x = spark.range(n).select(F.col("id"), (F.col("id") % 2).alias("k"), F.lit(1).alias("clash"))
    r = ranking.running(x, ["k"], "id", F.lit(1), "before")
    assert r.where("before <> id div 2").count() == 0 and r.count() == n
    assert ranking.positions(x, "id").where("pos <> id + 1").count() == 0


def test_first_usable_capture_is_a_home_page(spark, tmp_path):
    row = lambda d, path, ts: (f"https://{d}{path}", d, ts, "200", "text/html", "f", "1", "2")
    rows = [row("a.example", "/story/1", "20200101000000"), row("a.example", "/", "20210101000000"), row("b.example", "/story/2", "20200101000000"), row("c.example", "/?q=1", "20200101000000")]
    spark.createDataFrame(rows, "url string, domain string, capture_ts string, status string, mime string, filename string, offset_text string, length_text string").write.parquet(f"{tmp_path}/crawl_index.parquet")
    got = {(r["domain"], r["url"]) for r in catalogue.queries()["first_usable_capture"](spark, str(tmp_path)).collect()}
    assert got == {("a.example", "https://a.example/"), ("c.example", "https://c.example/?q=1")}


def test_single_replies():
    from tesserine.operators import replies

    assert replies.parse_one('[{"category": "News"}, {"category": "sports"}]')[1] == "news"
    assert replies.parse_one('Sure:\n```json\n{"category": "Shopping", "confidence": 2}\n```\nDone {x}.')[1:3] == ("shopping", 1.0)
    assert replies.parse_one("{category: \"health\", confidence: 0.4}")[1:3] == ("health", 0.4)
    assert replies.parse_one("I say it is classified as: finance, confidence: 0.7.")[1:3] == ("finance", 0.7)
    assert replies.parse_one('{"a": [1, 2], "note": "x}"} then {"category": "adult", "reasoning": "has {braces} and ]"}')[1] == "adult"
    assert replies.parse_one("[]") is None and replies.parse_one("") is None and replies.parse_one(None) is None
    assert [r[1] for r in replies.parse('Here: [{"category": "a1", "domain": "X.example"}, {"category": ""}, {"category": "b"}] end')] == ["a1", "b"]


def test_running_over_two_levels(spark):
    from pyspark.sql import functions as F

    from tesserine.operators import ranking

    n = ranking.BLOCK * 2 + 5
    df = spark.range(0, n * 3, 3).withColumn("k", F.col("id") % 2)
    got = ranking.running(df, ["k"], "id", F.lit(1), "before").where(f"id >= {3 * n - 30}").collect()
    assert got and all(r["before"] == r["id"] // 6 for r in got)
