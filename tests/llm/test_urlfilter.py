import pytest
from pyspark.sql import functions as F

from verdigris.llm.urlfilter import domain_of, host_of, judged_urls, path_of, reputations, suffix_of

URLS = [
    ("http://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net", "example.net", "", None, "allow"),
    ("https://example.net?q=/en/", "example.net", "", None, "allow"),
    ("x://other.net/", "other.net", "/", "net/", "block"),
    ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("http://b.example.com/de/1", "b.example.com", "/de/1", "example.com/de/", "block"),
    ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"),
    ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.org/fr/", "É.org", "/fr/", "org/fr/", "allow"),
    ("http://h#f/de/", "h", "", None, "allow"),
]


def test_parts_rules_and_verdicts(spark):
    pages = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)], "page_id bigint, url string").withColumns({"host": F.lit("x"), "site": F.lit(1), "verdict": F.lit(None).cast("int")})
    none = spark.createDataFrame([], "page_id bigint, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged_urls(pages, none).collect()}
    assert got == {k: u[1:] for k, u in enumerate(URLS)}
    assert judged_urls(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_lend_to_their_siblings(spark):
    rows = [(f"http://{h}.{d}/p{k}", bad) for h, d, bad, n in (("a", "bad.com", 1, 60), ("b", "bad.com", 1, 40), ("new", "bad.com", None, 2), ("c", "good.com", 0, 300), ("d", "good.com", 1, 1), ("e", "fine.org", 0, 200)) for k in range(n)]
    pages = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(rows)] + [(None, "http://a.bad.com/")], "page_id bigint, url string")
    outcomes = spark.createDataFrame([(k, b) for k, (_, b) in enumerate(rows) if b is not None] + [(None, 1), (0, None), (1, 7)], "page_id bigint, bad int")
    seen = {r.host: r.verdict for r in judged_urls(pages, outcomes).collect()}
    assert seen["a.bad.com"] == seen["b.bad.com"] == "block" and seen["c.good.com"] == seen["e.fine.org"] == seen["d.good.com"] == "allow"
    means = {r.site: r["mean"] for r in reputations(pages, outcomes).collect()}
    assert means["new.bad.com"] > 0.9 > 0.6 > means["d.good.com"] > means["c.good.com"] and means["a.bad.com"] > means["new.bad.com"]


@pytest.mark.parametrize(("site", "domain", "suffix"), [("a.b.example.co.uk", "example.co.uk", "co.uk"), ("a.example.com", "example.com", "com"), ("localhost", "localhost", "localhost"), ("10.0.0.1", "10.0.0.1", "1")])
def test_registered_domains(spark, site, domain, suffix):
    row = spark.range(1).select(domain_of(F.lit(site)).alias("d"), suffix_of(F.lit(site)).alias("s"), host_of(F.lit("q://U@h:1/x")).alias("h"), path_of(F.lit("q://U@h:1/x")).alias("p")).first()
    assert (row.d, row.s, row.h, row.p) == (domain, suffix, "u@h:1", "/x")
