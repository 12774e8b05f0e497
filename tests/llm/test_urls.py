import re

import duckdb
import pytest

from matrixloom.llm import urls

URLS = [
    "http://a.NET/x", "http://net/", "http://net", "https://www.example.net/en/1?x", "https://example.net/en", "https://Example.net/EN/", "x://sub.example.com/de/9#z",
    "x://example.com/de", "ftp://org/fr/", "ftp://a.org/fr/q", "ftp://aorg/fr/q", "no scheme", "", None, "://", "http://h.net?x=/en/", "http://casino.example.org/en/", "http://www.casino-win.com",
    "http://notcasino.com/", "http://poker-stars.online.io/", "http://x.com/CGI-bin/run", "http://x.com/wp-login.php", "a://b://c.net/", "http://u@example.net:80/en/",
]


def brute(url, rules):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in re.split(r"[/?#]", rest, maxsplit=1)[0])
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    fits = []
    for r in rules:
        if r.site:
            h, _, p = r.text.partition("/")
            if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(r)
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.action
    other = any(not r.site and re.search(r.regex, (host + path).lower()) for r in rules) and host
    return host, path, None, "block" if other else "allow"


def test_against_brute_force(spark):
    rules = urls.production_rules()
    rows = [(i // 2, u) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'q' AS host", "1 AS token", "2 AS id", "3 AS path")
    got = sorted(((r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages, rules).collect()), key=str)
    assert got == sorted(((i, *brute(u, rules)) for i, u in rows), key=str)
    assert urls.judged(pages.limit(0), rules).count() == 0


def test_every_rule_fits_only_urls_with_its_tokens():
    for r in urls.production_rules():
        for u in URLS:
            host, path, *_ = brute(u, [])
            said = host + path if r.site else (host + path).lower()
            if host and re.search(r.regex, said):
                assert set(r.tokens) <= set(re.split("[^a-z0-9]+", said.lower())), (r, u)


def test_tokens_next_to_a_wildcard_are_not_whole():
    assert urls.pattern_rule("^poker-*^online^").tokens == ("poker", "online")
    assert urls.pattern_rule("^pok*er^online^").tokens == ("online",)
    assert urls.site_rule("block", "x.com/ab").tokens == ("x", "com")
    with pytest.raises(ValueError):
        urls.pattern_rule("abc")


def test_whole_table_against_sql(spark, sf):
    pages = f"read_parquet('{sf}/pages.parquet')"
    want = duckdb.sql(urls.ORACLE.replace("FROM pages", f"FROM {pages}")).fetchall()
    cols = ["page_id", "host", "path", "rule", "verdict", "pattern"]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in urls.op3(spark, sf).select(cols).collect())
