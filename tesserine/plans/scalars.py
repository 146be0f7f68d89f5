"""Scalar operators over whole tables: addresses, text, page rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import outcomes, rules, text, url
from ..operators import addresses, htmltext
from .base import q, query, sql_any, sql_list, table

W = text.WS
SQL_DOMAIN = "CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://([^/?#]*)', 1) WHEN contains(url, '/') AND contains(regexp_extract(url, '^([^/]*)', 1), '.') THEN regexp_extract(url, '^([^/]*)', 1) ELSE url END"
SQL_BARE = "regexp_extract(regexp_replace(domain, '^https?://', ''), '^([^/]*)', 1)"
SQL_COLLAPSE = f"trim(regexp_replace(text, {q(W + '+')}, ' ', 'g'))"


def sql_tokens(col: str) -> str:
    return f"coalesce(len([w for w in regexp_split_to_array({col}, {q(W + '+')}) if w <> '']), 0)"


SQL_TITLE = f"lower(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), {q('^' + W + '+')}, ''), {q(W + '+$')}, ''))"
#: Addresses in spellings the tables lack.
ODD = (
    "https://example.com:8080/path", "https://", "sub.example.com/path", "a.example?x", "HTTP://UPPER.example/", "user:pw@host.example/x", "ftp://files.example/a.exe",
    "http://127.0.0.1/x", "http://[::1]/", "https://site.example/download/pack.tar.gz?v=1", "https://site.example/get?download=1", "https://site.example/run.exe?x=1",
    "http://printer.local/", "https://nodots/", "https://shop.example/attachment/7", "example", "setup.exe", "http://files.zip", "https://a.example?f=x.exe", "https://x.example/setup.MSI", "-bad.example", "a..b.example",
)
SQL_URLS = "(SELECT DISTINCT url FROM crawl_index WHERE url IS NOT NULL UNION SELECT * FROM (VALUES " + ", ".join(f"({q(u)})" for u in ODD) + ") t(url))"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    odd = spark.createDataFrame([(u,) for u in ODD], "url string")
    return table(spark, d, "crawl_index").select("url").where("url is not null").union(odd).distinct()


@query(f"SELECT url, {SQL_DOMAIN} AS domain FROM {SQL_URLS}")
def url_to_domain(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("url", url.domain_of(F.col("url")).alias("domain"))


@query(
    f"SELECT domain, regexp_matches({SQL_BARE}, {q(url.DOMAIN)}) AND length({SQL_BARE}) <= 253 AS valid FROM "
    f"(SELECT DISTINCT {SQL_DOMAIN} AS domain FROM {SQL_URLS} UNION SELECT DISTINCT domain FROM verdicts) t WHERE domain IS NOT NULL"
)
def domain_valid(spark: SparkSession, d: str) -> DataFrame:
    both = _urls(spark, d).select(url.domain_of(F.col("url")).alias("domain")).union(table(spark, d, "verdicts").select("domain")).where("domain is not null").distinct()
    return both.select("domain", url.is_valid_domain(F.col("domain")).alias("valid"))


@query("SELECT DISTINCT domain, regexp_replace(domain, '\\.[^.]*$', '') AS stem FROM fetch_results WHERE domain IS NOT NULL")
def domain_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("domain is not null").select("domain", url.stem(F.col("domain")).alias("stem")).distinct()


@query("SELECT fetch_id, concat_ws('@', domain, substr(snapshot_timestamp, 1, 8)) AS stem FROM (SELECT fetch_id, domain, nullif(snapshot_timestamp, '') AS snapshot_timestamp FROM fetch_results) t")
def cache_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").select("fetch_id", url.cache_stem(F.col("domain"), outcomes.given(F.col("snapshot_timestamp"))).alias("stem"))


@query("SELECT DISTINCT url, capture_ts, concat('https://web.archive.org/web/', capture_ts, 'if_/', url) AS playback FROM crawl_index WHERE url <> '' AND capture_ts <> ''")
def playback_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "crawl_index").where("url <> '' and capture_ts <> ''").select("url", "capture_ts", url.playback_url(F.col("capture_ts"), F.col("url")).alias("playback")).distinct()


def _entry_sql() -> str:
    host = r"lower(regexp_extract(url, '^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1))"
    inner = " OR ".join(f"ends_with(h, {q(s)})" for s in K.INTERNAL_SUFFIXES)
    return f"SELECT url, h <> '' AND NOT ({inner}) AND contains(h, '.') AND NOT (regexp_matches(h, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(h, '[')) AS allowed FROM (SELECT url, {host} AS h FROM {SQL_URLS}) t"


@query(_entry_sql())
def url_entry_check(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("url", url.entry_ok(F.col("url")).alias("allowed"))


def _safe_sql() -> str:
    path = r"lower(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?[^/?#]*([^?#]*)', 1))"
    bad = " OR ".join([f"ends_with(p, {q(e)})" for e in K.BLOCKED_EXTENSIONS] + [f"(p = '' AND ends_with(lower(url), {q(e)}))" for e in K.BLOCKED_EXTENSIONS if e != ".com"] + [f"regexp_matches(url, {q('(?i)^' + s)})" for s in K.SUSPICIOUS_URLS])
    return f"SELECT url, NOT ({bad}) AS safe FROM (SELECT url, {path} AS p FROM {SQL_URLS}) t"


@query(_safe_sql())
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    return _urls(spark, d).select("url", url.is_safe_url(F.col("url")).alias("safe"))


@query(
    "SELECT url, domain, capture_ts, filename, offset_text, coalesce(status = '200' AND contains(mime, 'html') AND coalesce(filename, '') <> '' AND coalesce(offset_text, '') <> '' AND coalesce(length_text, '') <> '' "
    "AND contains(url, domain) AND (p IN ('', '/', '/index.html') OR starts_with(p, '/?') OR starts_with(p, '/#')), FALSE) AS usable FROM "
    "(SELECT DISTINCT *, substr(url, instr(url, domain) + length(domain)) AS p FROM crawl_index) t"
)
def usable_capture(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "crawl_index").distinct()
    cols = [F.col(c) for c in ("status", "mime", "filename", "offset_text", "length_text", "url", "domain")]
    return x.select("url", "domain", "capture_ts", "filename", "offset_text", url.usable_capture(*cols).alias("usable"))


@query("SELECT capture_ts, CASE WHEN regexp_matches(substr(capture_ts, 1, 8), '^[0-9]{8}$') AND try_strptime(substr(capture_ts, 1, 8), '%Y%m%d') >= TIMESTAMP '2000-01-01' THEN CAST(try_strptime(substr(capture_ts, 1, 8), '%Y%m%d') AS DATE) END AS day FROM (SELECT DISTINCT capture_ts FROM crawl_index UNION SELECT * FROM (VALUES ('20240230'), ('19991231'), ('2024'), ('20240229')) v(capture_ts)) t")
def archive_date_valid(spark: SparkSession, d: str) -> DataFrame:
    odd = spark.createDataFrame([("20240230",), ("19991231",), ("2024",), ("20240229",)], "capture_ts string")
    x = table(spark, d, "crawl_index").select("capture_ts").union(odd).distinct()
    return x.select("capture_ts", rules.archive_date(F.substring("capture_ts", 1, 8)).alias("day"))


@query(f"SELECT fetch_id, {SQL_TITLE} AS title FROM fetch_results WHERE html <> ''")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("html <> ''").select("fetch_id", text.html_title(F.col("html")).alias("title"))


@query("SELECT fetch_id, coalesce(" + ", ".join(f"nullif(regexp_extract(html, {q(p)}, 1), '')" for p in text.DESCRIPTIONS) + ") AS description FROM fetch_results WHERE html <> ''")
def html_description(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("html <> ''").select("fetch_id", text.html_description(F.col("html")).alias("description"))


def _docs(f, name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "documents").select("doc_id", f(F.col("text")).alias(name))

    return run


def _named(name: str, f, sql: str, out: str) -> None:
    run = _docs(f, out)
    run.__name__ = name
    query(sql)(run)


_named("text_clean_minimal", text.clean, f"SELECT doc_id, lower({SQL_COLLAPSE}) AS cleaned FROM documents", "cleaned")
_named(
    "text_clean_nopunct", text.clean_words,
    f"SELECT doc_id, array_to_string([w for w in string_split(lower({SQL_COLLAPSE}), ' ') if w <> '' AND NOT regexp_matches(w, {q('^' + text.PUNCT + '+$')})], ' ') AS cleaned FROM documents", "cleaned",
)
_named(
    "text_clean_set", text.clean_set,
    "SELECT doc_id, array_to_string(list_sort(list_distinct([w for w in [lower(regexp_replace(regexp_replace(x, '^[!-/:-@\\[-`{-~]+', ''), '[!-/:-@\\[-`{-~]+$', '')) for x in string_split(trim(regexp_replace(regexp_replace(text, '\\p{Nd}', '', 'g'), "
    + q(W + "+") + ", ' ', 'g')), ' ')] if regexp_matches(w, '^[a-z]{2,}$') AND w NOT IN " + sql_list(K.COMMON_WORDS) + "])), ' ') AS cleaned FROM documents", "cleaned",
)
_named("token_count", text.tokens, f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents", "tokens")
_named("truncate_marker", lambda c: text.truncated(c, 2000), "SELECT doc_id, CASE WHEN length(text) > 2000 THEN concat(left(text, 2000), '... [truncated]') ELSE text END AS content FROM documents", "content")
_named("excerpt", lambda c: text.excerpt(c, 400), f"SELECT doc_id, left({SQL_COLLAPSE}, 400) AS excerpt FROM documents", "excerpt")


def _visible_sql() -> str:
    x = "html"
    for p in ("(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?is)<title[^>]*>.*?</title>", "(?s)<!--.*?-->", "(?i)<!doctype[^>]*>", "(?s)<[^>]*>"):
        x = f"regexp_replace({x}, {q(p)}, ' ', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&amp;", "&")):
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"SELECT fetch_id, trim(regexp_replace({x}, {q(W + '+')}, ' ', 'g')) AS visible FROM fetch_results WHERE html <> ''"


@query(_visible_sql())
def visible_text_sql(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fetch_results").where("html <> ''").select("fetch_id", text.visible(F.col("html")).alias("visible"))


@query()
def visible_text(spark: SparkSession, d: str) -> DataFrame:
    """Text nodes of a parsed page (parser semantics, beyond regular expressions)."""
    return table(spark, d, "fetch_results").where("html <> ''").select("fetch_id", htmltext.visible_text("html").alias("visible"))


@query()
def main_text(spark: SparkSession, d: str) -> DataFrame:
    """Main content, or all visible text where none stands out."""
    x = table(spark, d, "fetch_results").where("html <> ''").select("fetch_id", htmltext.main_text("html").alias("main"), htmltext.visible_text("html").alias("all"))
    return x.select("fetch_id", F.coalesce(F.nullif("main", F.lit("")), "all").alias("main"))


# -- page rules, over pages with the triggers the tables lack put in -------------
TRIGGERS = (
    (0, '<script src="https://ct.captcha-delivery.com/c.js"></script>'), (1, "<script>window._cf_chl_opt={}</script>"), (2, "<title>Just a moment...</title>"),
    (3, '<div class="g-recaptcha"></div>'), (4, "<div class=\"g-recaptcha\"></div>you don't have permission to access"), (5, "Access denied"), (6, "reference #18.2"),
)
SQL_TRIGGER = "CASE fetch_id % 11 " + " ".join(f"WHEN {i} THEN concat({q(t)}, html)" for i, t in TRIGGERS) + " ELSE html END"


def _trigger() -> Column:
    x = F.col("fetch_id") % 11
    out = F.when(F.lit(False), F.col("html"))
    for i, t in TRIGGERS:
        out = out.when(x == i, F.concat(F.lit(t), F.col("html")))
    return out.otherwise(F.col("html"))


def _block_sql() -> str:
    rows = [(sql_any("l", m), v, "strong_marker") for v, m in K.STRONG_MARKERS]
    rows.append((f"t IN {sql_list(K.CHALLENGE_TITLES)}", "challenge_title", "title"))
    rows.append((f"status IN {tuple(K.BLOCK_STATUSES)}", "http", "status"))
    rows += [(f"suspect AND {sql_any('l', m)}", v, "weak_marker") for v, m in K.WEAK_MARKERS]
    rows += [("stub", "stub", "stub"), ("denial AND suspect", "access_denied", "text")]
    case = lambda i: "CASE " + " ".join(f"WHEN {c} THEN {q((v, r)[i])}" for c, v, r in rows) + " END"
    inner = f"SELECT fetch_id, domain, {SQL_TRIGGER} AS html, CASE WHEN error_code = 'http_error' THEN 503 END AS status FROM fetch_results WHERE html <> ''"
    t = f"SELECT *, lower(html) AS l, {SQL_TITLE} AS t, regexp_matches(html, {q(K.DENIAL)}) AS denial FROM ({inner}) i"
    s = f"SELECT *, coalesce(lower(trim(domain)), '') <> '' AND t = lower(trim(domain)) AND length(html) < {K.STUB_MAX} AS stub FROM ({t}) j"
    u = f"SELECT *, t IN {sql_list(K.CHALLENGE_TITLES)} OR stub OR (length(html) < {K.INTERSTITIAL_MAX} AND denial) AS suspect FROM ({s}) k"
    return f"SELECT fetch_id, vendor IS NOT NULL AS blocked, vendor, reason FROM (SELECT fetch_id, {case(0)} AS vendor, {case(1)} AS reason FROM ({u}) m) n"


@query(_block_sql())
def block_detect(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fetch_results").where("html <> ''").withColumn("html", _trigger()).withColumn("status", F.when(F.col("error_code") == "http_error", 503))
    return x.withColumn("b", rules.block(F.col("html"), F.col("domain"), F.col("status"))).select("fetch_id", "b.blocked", "b.vendor", "b.reason")


TEXT_TRIGGERS = ((0, "this domain is for sale"), (3, "account suspended"))
SQL_TEXT_TRIGGER = "CASE doc_id % 13 WHEN 0 THEN 'this domain is for sale' WHEN 1 THEN concat(text, ' sedo.com') WHEN 2 THEN concat('this guitar is for sale ', text) WHEN 3 THEN 'account suspended' WHEN 4 THEN concat('coming soon ', text) ELSE text END"


def _text_trigger() -> Column:
    x = F.col("doc_id") % 13
    t = F.col("text")
    return F.when(x == 0, "this domain is for sale").when(x == 1, F.concat(t, F.lit(" sedo.com"))).when(x == 2, F.concat(F.lit("this guitar is for sale "), t)).when(x == 3, "account suspended").when(x == 4, F.concat(F.lit("coming soon "), t)).otherwise(t)


SQL_PARKED = f"({sql_any('l', K.PARKING_SERVICES)} OR ({sql_tokens('l')} <= {K.PARKED_MAX_WORDS} AND {sql_any('l', K.PARKING_PHRASES)}))"
SQL_UNAVAILABLE = f"({sql_tokens('l')} <= {K.UNAVAILABLE_MAX_WORDS} AND ({sql_any('l', K.SERVER_ARTIFACTS)} OR {sql_any('l', K.UNAVAILABLE_PHRASES)}))"
SQL_TRIGGERED = f"(SELECT *, lower(coalesce(x, '')) AS l FROM (SELECT *, {SQL_TEXT_TRIGGER} AS x FROM documents) a) b"


def triggered(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("x", _text_trigger())


@query(f"SELECT doc_id, {SQL_PARKED} AS parked, {SQL_UNAVAILABLE} AS unavailable, {sql_tokens('x')} < {K.MIN_TOKENS} AS thin FROM {SQL_TRIGGERED}")
def placeholder_rules(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return triggered(spark, d).select("doc_id", rules.parked(x).alias("parked"), rules.unavailable(x).alias("unavailable"), rules.thin(x).alias("thin"))


@query(
    f"SELECT doc_id, CASE WHEN t = 0 THEN 'empty_text' WHEN t < {K.MIN_TOKENS} THEN 'thin_content' END AS error_code, CASE WHEN t = 0 THEN 'no meaningful text' WHEN t < {K.MIN_TOKENS} THEN concat('only ', t, ' tokens, {K.MIN_TOKENS} needed') END AS error FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents) a"
)
def score_or_refuse(spark: SparkSession, d: str) -> DataFrame:
    """The gate before scoring: blank and thin texts are refused by code."""
    t = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select(
        "doc_id",
        F.when(F.col("t") == 0, "empty_text").when(F.col("t") < K.MIN_TOKENS, "thin_content").alias("error_code"),
        F.when(F.col("t") == 0, "no meaningful text").when(F.col("t") < K.MIN_TOKENS, F.concat(F.lit("only "), "t", F.lit(f" tokens, {K.MIN_TOKENS} needed"))).alias("error"),
    )


MESSAGES = (
    "Timeout 30000ms exceeded", "Name or service not known", "blocked by robots.txt", "HTTP 429 Too Many Requests", "no snapshot near 2020", "connection refused", "unexpected http status 500", "something else",
)


def _error_sql(m: str) -> str:
    return (
        f"CASE WHEN contains({m}, 'timeout') THEN 'timeout' WHEN {sql_any(m, ('name or service not known', 'nodename nor servname'))} THEN 'dns_error' WHEN contains({m}, 'robots') THEN 'robots_blocked' "
        f"WHEN {sql_any(m, ('429', 'rate limit'))} THEN 'archive_rate_limited' WHEN {sql_any(m, ('no snapshot', 'no archive', 'no memento'))} THEN 'no_archive_snapshot' WHEN contains({m}, 'connection') THEN 'connection_error' "
        f"WHEN contains({m}, 'status') AND contains({m}, 'http') THEN 'http_error' ELSE 'unknown' END"
    )


@query(f"SELECT message, {_error_sql('lower(message)')} AS code FROM (SELECT DISTINCT error AS message FROM fetch_results WHERE error <> '' UNION SELECT * FROM (VALUES " + ", ".join(f"({q(m)})" for m in MESSAGES) + ") v(message)) t")
def error_classify(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "fetch_results").where("error <> ''").select(F.col("error").alias("message")).union(spark.createDataFrame([(m,) for m in MESSAGES], "message string")).distinct()
    return x.select("message", outcomes.error_code(F.col("message")).alias("code"))


@query(
    f"SELECT url, capture_ts, n, n > CASE kind WHEN 'text/html' THEN {K.HTML_LIMIT} WHEN 'application/pdf' THEN {K.PDF_LIMIT} ELSE {K.OTHER_LIMIT} END AS too_large, n IS NULL AS unknown FROM (SELECT DISTINCT url, capture_ts, mime AS kind, TRY_CAST(length_text AS BIGINT) * 1000 AS n FROM crawl_index) t"
)
def content_length_limit(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("length_text").try_cast("bigint") * 1000
    x = table(spark, d, "crawl_index").select("url", "capture_ts", F.col("mime").alias("kind"), n.alias("n")).distinct()
    return x.select("url", "capture_ts", "n", (F.col("n") > rules.length_limit(F.col("kind"))).alias("too_large"), F.col("n").isNull().alias("unknown"))


ALLOWED_TYPES = ("text/html", "application/xhtml+xml", "text/plain")


@query(f"SELECT mime, count(*) AS rows, coalesce(bool_or({' OR '.join(f'starts_with(lower(mime), {q(t)})' for t in ALLOWED_TYPES)}), FALSE) AS allowed, mime IS NULL OR mime = '' AS warn FROM crawl_index GROUP BY mime")
def content_type_rules(spark: SparkSession, d: str) -> DataFrame:
    ok = F.lit(False)
    for t in ALLOWED_TYPES:
        ok = ok | F.startswith(F.lower("mime"), F.lit(t))
    return table(spark, d, "crawl_index").groupBy("mime").agg(F.count("*").alias("rows"), F.coalesce(F.bool_or(ok), F.lit(False)).alias("allowed")).withColumn("warn", F.coalesce(F.col("mime"), F.lit("")) == "")


ROBOTS = ((200, 1000, True), (200, 600_000, True), (200, 10, False), (404, 0, False), (403, 0, False), (503, 0, True), (None, 0, False))


@query(
    "SELECT status, size, parsed, CASE WHEN status >= 500 THEN FALSE WHEN status >= 400 THEN TRUE WHEN size > 512000 THEN FALSE WHEN status IS NULL THEN TRUE ELSE parsed END AS allowed FROM (VALUES "
    + ", ".join(f"({'NULL' if s is None else s}, {n}, {str(p).upper()})" for s, n, p in ROBOTS) + ") t(status, size, parsed)"
)
def robots_decision(spark: SparkSession, d: str) -> DataFrame:
    x = spark.createDataFrame(list(ROBOTS), "status int, size int, parsed boolean")
    return x.withColumn("allowed", rules.robots_allow(F.col("status"), F.col("size"), F.col("parsed")))


ADDRESSES = ("8.8.8.8", "10.0.0.1", "127.0.0.1", "169.254.1.1", "::1", "2001:4860:4860::8888", "::ffff:10.0.0.1", "224.0.0.1", "240.0.0.1", "garbage", "", "192.0.2.1")


@query()
def ip_global(spark: SparkSession, d: str) -> DataFrame:
    """Whether an address text is publicly routable."""
    x = spark.createDataFrame([(a,) for a in ADDRESSES], "addr string")
    return x.select("addr", addresses.is_global("addr").alias("public"))
