from __future__ import annotations

import duckdb
from compare import difference
from pyspark.sql import functions as F

from eventloom.llm.hosts import HOST_SQL, domain_of, filter_urls, parsed, reputation, suffix_of


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "<html>", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, rule string")


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_urls(spark):
    urls = {
        "https://A.Example.ORG/es/1?q#f": ("a.example.org", "/es/1"),
        "no scheme/x": ("", ""),
        None: ("", ""),
        "": ("", ""),
        "x://HÉ.net?a/b": ("hÉ.net", ""),
        "http://h.com#/de/": ("h.com", ""),
        "a://b://c/d": ("b:", "//c/d"),
        "://k/p": ("k", "/p"),
        "http://h.net/a\nb?c": ("h.net", "/a\nb"),
    }
    got = {r.page_id: (r.host, r.path) for r in parsed(pages(spark, urls)).collect()}
    assert [got[k] for k in range(len(urls))] == list(urls.values())


def test_rules(spark):
    urls = {
        "http://example.org/es/7": ("example.org/es/", "block"),
        "http://a.b.example.org/en/12": ("example.org/en/1", "block"),
        "http://example.org/en/2": ("org/", "allow"),
        "http://org/": ("org/", "allow"),
        "http://org": (None, "allow"),
        "http://badexample.org/es/7": ("org/", "allow"),
        "http://x.com/fr/1": ("com/fr/", "allow"),
        "http://x.com/de/1": ("com/de/", "block"),
        "http://x.com/DE/1": (None, "allow"),
        None: (None, "allow"),
    }
    rows = filter_urls(pages(spark, urls), labels(spark, [])).collect()
    got = {r.page_id: (r.rule, r.verdict) for r in rows}
    assert [got[k] for k in range(len(urls))] == list(urls.values())
    assert filter_urls(pages(spark, []), labels(spark, [])).count() == 0


def test_shrinkage(spark):
    """Many bad pages block a host; a few, in a clean domain, do not."""
    urls = [f"http://good{k % 20}.fine.net/en/{k}" for k in range(400)]
    urls += [f"http://bad.fine.net/en/{1000 + k}" for k in range(60)] + ["http://new.fine.net/en/2000", "http://other.net/x"]
    known = [(k, 1, 0) for k in range(400)] + [(1000 + k, 0, 0) for k in range(60)] + [(2000, 1, 1), (2000, 1, 0), (None, 0, 0), (5, None, 0)]
    verdicts = {r.page_id: r.verdict for r in filter_urls(pages(spark, urls), labels(spark, known)).collect()}
    assert {verdicts[k] for k in range(400)} == {"allow"}
    assert {verdicts[400 + k] for k in range(60)} == {"block"}
    assert verdicts[460] == "allow" and verdicts[461] == "allow"
    counts = spark.createDataFrame([("a.x.net", 100, 50), ("b.x.net", 2, 0), ("c.y.net", 100, 1)], "host string, n long, bad long")
    hosts = spark.createDataFrame([(h,) for h in ("a.x.net", "b.x.net", "c.y.net", "d.x.net", "d.y.net", "q")], "host string")
    share = {r.host: r.bad_share for r in reputation(counts, hosts).collect()}
    assert share["a.x.net"] > share["d.x.net"] > share["b.x.net"] > share["c.y.net"]
    assert share["d.x.net"] > share["q"] > share["d.y.net"]


def test_suffixes(spark):
    """Sites under a country's second level don't share a registered domain; SQL agrees."""
    hosts = {
        "a.b.gov.uk": ("b.gov.uk", "gov.uk"), "co.nz": ("co.nz", "co.nz"), "x.com.cn": ("x.com.cn", "com.cn"),
        "x.co.com": ("co.com", "com"), "a.b.de": ("b.de", "de"), "www.co": ("www.co", "co"), "": ("", ""), "q": ("q", "q"),
    }
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", domain_of(F.col("host")).alias("d"), suffix_of(F.col("host")).alias("s")).collect()}
    assert got == hosts
    urls = [f"http://h{k % 9}.site{k % 4}.{s}/en/{n}" for n, (k, s) in enumerate((k, s) for k in range(40) for s in ("gov.uk", "co.in", "com", "org.uk"))]
    known = [(n, int(n % 4 != 1 or n % 3 == 0), int(n % 11 == 0)) for n in range(0, 160, 1) if n % 5]
    con = duckdb.connect()
    con.register("pages", pages(spark, urls).select("page_id", "url").toPandas())
    con.register("labels", labels(spark, known).toPandas())
    out = filter_urls(pages(spark, urls), labels(spark, known)).toPandas()
    assert difference(out, con.execute(HOST_SQL).df()) is None
    assert set(out.verdict) == {"allow", "block"}
