"""Readers and writers round trip."""

from __future__ import annotations

import gzip

import pytest

from tesserine.sources import readers, writers


def test_domain_list(spark, tmp_path):
    p = tmp_path / "d.txt"
    p.write_text("a.example\n# no\n\n  b.example \n")
    assert [r["name"] for r in readers.domain_list(spark, str(p)).orderBy("pos").collect()] == ["a.example", "b.example"]


def test_gold(spark, tmp_path):
    p = tmp_path / "g.csv"
    p.write_text("# note\ndomain,expected\nA.example,news\n")
    assert [tuple(r) for r in readers.gold_labels(spark, str(p)).collect()] == [("a.example", "news")]
    p.write_text("domain,expected\na.example,nonsense\n")
    with pytest.raises(Exception, match="unknown label"):
        readers.gold_labels(spark, str(p)).collect()


def test_corpus_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("train", "a.example", "news", "t"), ("val", "b.example", "music", None)], "split string, domain string, category string, text string")
    writers.splits(x, str(tmp_path / "c"))
    back = spark.read.schema("domain string, category string, text string, split string").json(str(tmp_path / "c"))
    assert sorted(map(tuple, back.select("split", "domain", "category", "text").collect())) == sorted(map(tuple, x.collect()))


def test_log_keeps_the_last(spark, tmp_path):
    p = str(tmp_path / "log")
    for seq, c in ((1, "news"), (2, "music")):
        writers.append_log(spark.createDataFrame([("a.example", c, "h", seq)], "domain string, category string, prompt_hash string, logged_at long"), p)
    assert [r["category"] for r in readers.verdict_log(spark, p, "h").collect()] == ["music"]


def test_html_tree_and_definitions(spark, tmp_path):
    (tmp_path / "t" / "finance__banking").mkdir(parents=True)
    (tmp_path / "t" / "finance__banking" / "A.example.html").write_text("<p>x</p>")
    assert [tuple(r) for r in readers.html_tree(spark, str(tmp_path / "t")).collect()] == [("finance/banking", "a.example", "<p>x</p>")]
    (tmp_path / "g.tsv").write_text("porn\tfirst  gloss\nsex\tsecond\nno tab\n")
    assert [tuple(r) for r in readers.definitions(spark, str(tmp_path / "g.tsv")).collect()] == [("adult", "first gloss")]


def test_warc(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\xff</p>"
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: https://a.example/\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    (tmp_path / "1.gz").write_bytes(gzip.compress(rec))
    (tmp_path / "2.gz").write_bytes(b"broken")
    assert [(r["url"], r["html"]) for r in readers.warc(spark, str(tmp_path)).collect()] == [("https://a.example/", "<p>�</p>")]
    assert readers.warc_body(None) is None
