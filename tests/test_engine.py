"""Engine, scorers, settings, crawls."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tesserine.config import Config
from tesserine.engine import Engine
from tesserine.operators import crawls
from tesserine.scoring import LogitScorer, TextScorer

COLS = "fetch_id long, url string, domain string, html string, text string, error string, error_code string, source string, logits array<double>"


def pages(spark):
    words = "word " * 40
    return spark.createDataFrame(
        [
            (1, "https://a.example/", "a.example", None, words, "", "", "live", [3.0, 0.0]),
            (2, "https://b.example/", "b.example", "<title>Just a moment...</title>", words, "", "", "live", [0.0, 1.0]),
            (3, "https://c.example/", "c.example", None, "few words", "", None, "archive", [0.0, 1.0]),
            (4, "https://d.example/", "d.example", None, "", "boom", "timeout", None, None),
            (5, "https://e.example/", "e.example", f"<p>{words}</p><script>x</script>", None, None, None, "live", [0.0, 0.0]),
        ],
        COLS,
    )


def test_engine(spark):
    e = Engine(LogitScorer(["news", "music"]), Config())
    got = {r["fetch_id"]: r for r in e.classify(pages(spark)).collect()}
    assert {i: (r["category"], r["error_code"]) for i, r in got.items()} == {1: ("news", None), 2: (None, "bot_blocked"), 3: (None, "thin_content"), 4: (None, "timeout"), 5: ("news", None)}
    assert got[4]["retryable"] and not got[3]["retryable"] and got[1]["confidence"] == pytest.approx(0.952574, abs=1e-6)
    assert [c["category"] for c in got[5]["categories"]] == ["news", "music"] and [c["category"] for c in got[1]["categories"]] == ["news"]
    asked = spark.createDataFrame([("a.example",), ("https://a.example/x",), ("nobody.example",)], "name string")
    rows, report = e.run(asked, pages(spark))
    out = rows.collect()
    assert len(out) == 6 and sum(r["fetch_id"] == 1 for r in out) == 1 and [r["status"] for r in out if r["name"] == "nobody.example"] == ["failed"]
    assert {(r["dim"], r["value"]): r["n"] for r in report.collect()}["source", "live"] == 2


def test_text_scorer(spark):
    x = spark.createDataFrame([("ball goal match " * 5, "sports"), ("guitar song chord " * 5, "music")] * 5, "text string, category string")
    s = TextScorer.fit(x, features=256)
    p = s.score(x.withColumn("words", F.lit("clash"))).select("category", "p").collect()
    assert s.labels == ["music", "sports"] and all(r["p"][s.labels.index(r["category"])] > 0.8 for r in p)


def test_config(monkeypatch):
    monkeypatch.setenv("TESSERINE_MIN_TOKENS", "7")
    monkeypatch.setenv("TESSERINE_LABEL_FLOOR", "much")
    c = Config.from_env()
    assert c.min_tokens == 7 and c.label_floor == 0.10 and c.updated(batch_size=3).batch_size == 3


def test_crawls():
    ids = ["X-2025-51", "X-2026-04", "broken", "X-2026-01"]
    assert crawls.nearest_crawls(ids, "20251231") == ["X-2026-01", "X-2025-51", "X-2026-04", "broken"]
    assert crawls.nearest_crawls(ids, "no") == ids
    assert crawls.prompt_hash(["a"], None, 5) == crawls.prompt_hash(["a"], {}, 5) != crawls.prompt_hash(["b"], None, 5)
