"""URL rules against a plain loop."""

from __future__ import annotations

import hashlib
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from loomline.llm import url_filter
from loomline.llm.queries import LISTED, RULES, listed_pages, op3_url_filter

SF = "/root/testdata/sf0.01"


def canonical(host, path):
    bare = re.sub(":[0-9]*$", "", re.sub("^.*@", "", host)).rstrip(".")
    return bare, bare + re.sub("/+", "/", f"/{unquote(path)}")


def judged(url, rules, listed):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None, "allow"
    host, path = "".join(c.lower() if c.isascii() else c for c in m[1]), m[2]

    def fits(entry):
        h, slash, p = entry.partition("/")
        return (host == h or host.endswith(f".{h}")) and path.startswith(slash + p)

    bare, page = canonical(host, path)
    best = max((e for e in rules if fits(e)), key=len, default=None)
    hit = any(page == e if "/" in e else bare == e or bare.endswith(f".{e}") for e in listed)
    return host, path, best, rules[best] if best else "block" if hit else "allow"


def of_pages(urls):
    """The listed addresses: by the first digit of the digest of host and path."""
    addresses = {judged(u, {}, ())[:2] for u in urls if u and "://" in u}
    return {canonical(h, p or "/")[1] for h, p in addresses if hashlib.sha256(f"{h}{p or '/'}".encode()).hexdigest()[0] == "3"}


def test_query_equals_a_loop(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    listed = of_pages([r.url for r in pages]) | set(LISTED)
    want = sorted((r.page_id, *judged(r.url, RULES, listed)) for r in pages)
    made = sorted(tuple(r) for r in op3_url_filter(spark, SF).collect())
    assert made == want and len([m for m in made if m[3] is None and m[4] == "block"]) > 10


def test_listing_of_pages_fills_many_blocks(spark):
    """The filter of the list has many blocks, lets every listed address through and few of the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    listing = listed_pages(pages)
    known = url_filter.keyed(listing)
    n = known.count()
    assert n == len(of_pages([r.url for r in pages.collect()])) > 100
    blocks = 1 << max(0, -(-n * url_filter.BITS_PER_ENTRY // 512) - 1).bit_length()
    filled = url_filter.bloom(known, blocks)
    assert blocks >= 4 and filled.count() > blocks // 2
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    keys = pages.select(F.concat(F.lit("u "), url_filter.canonical_host(host), url_filter.canonical_path(path)).alias("key")).distinct()
    passed = url_filter.maybe(keys, filled, blocks)
    others = passed.join(known, "key", "left_anti").count()
    assert passed.join(known, "key", "left_semi").count() == n and others < 0.05 * keys.count()


def test_edge_cases(spark):
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.com/en/7?x#y", "http://a.example.com/en/8", "http://xexample.com/en/7", "http://b.net/de/", "http://com/en/", "http://example.net/de/8://x", "http://É.com/en/1", "ftp://cheap-pills.example.com", "a\nhttp://x.org/es/", "http://me:pw@WWW.Free-Bets.example.org.:8080/x", "http://free-bets.example.org@other.com/"]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(5, urls[5], "old")], "page_id int, url string, verdict string")
    made = url_filter.judge(frame, url_filter.entries(spark, RULES, LISTED)).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *judged(u, RULES, LISTED)) for i, u in enumerate(urls)] + [(5, *judged(urls[5], RULES, LISTED))]
    assert sorted(tuple(r) for r in made) == sorted(want)


def test_no_entries_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "http://a/b")], "page_id int, url string")
    assert [r.verdict for r in url_filter.judge(frame, spark.createDataFrame([], "entry string, verdict string, is_rule boolean")).collect()] == ["allow"]
    assert url_filter.judge(frame.limit(0), url_filter.entries(spark, RULES, LISTED)).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5_000).selectExpr("concat('k', id) as key")
    filled = url_filter.bloom(keys, 128)
    assert url_filter.maybe(keys, filled, 128).count() == 5_000
    others = spark.range(5_000).selectExpr("concat('other', id) as key")
    assert url_filter.maybe(others, filled, 128).count() < 500


def test_pages_of_a_long_list_in_any_spelling(spark, monkeypatch):
    listed = [f"site{i % 97}.example.com/page/{i} {i}" for i in range(5_000)] + LISTED
    urls = [f"https://site{i % 97}.example.com/page/{i}%20{i}?q=1" for i in range(0, 10_000, 7)]
    urls += ["http://u@SITE3.example.com.:80//page///100%20100#top", "http://site3.example.com/page/100+100", "http://site3.example.com/page/100%2", "http://a.site3.example.com/page/100%20100"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id int, url string")
    monkeypatch.setattr(url_filter, "BITS_PER_ENTRY", 1)  # a filter so full that the join has false positives to remove
    made = {r.page_id: r.verdict for r in url_filter.judge(frame, url_filter.entries(spark, RULES, listed)).collect()}
    assert made == {i: judged(u, RULES, set(listed))[3] for i, u in enumerate(urls)}
    assert "block" in made.values() and made[len(urls) - 4] == "block" and made[len(urls) - 1] == "allow"


def test_join_removes_false_positives(spark):
    keys = spark.range(5_000).selectExpr("concat('k', id) as key")
    filled = url_filter.bloom(keys, 16)
    others = spark.range(5_000).selectExpr("concat('other', id) as key")
    passed = url_filter.maybe(others, filled, 16)
    assert passed.count() > 100 and passed.join(keys, "key").count() == 0
